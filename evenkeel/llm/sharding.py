"""Sharding by extendible hashing.

A document's key is 120 bits: a hash of its id and text, then a hash of its place in the
input, which alone tells exact repeats of a row apart. A shard is a prefix of the key.
All documents begin under the empty prefix; a prefix whose documents exceed the byte
limit is split on the next bit, the others stay, until every shard fits. The directory
is indexed by the first `depth` bits, depth being the longest shard's prefix; a shard of
fewer bits owns several entries.

Levels are walked over a small table of keys and bytes, without texts; only keys under
prefixes that still exceed the limit go on to the next level. Documents meet the directory
in one join at the end, by broadcast while its number of entries is under
`most_broadcast`.

Defined results. A null text has 0 bytes; every row counts `overhead` bytes besides its
text. A row larger than the limit has a shard for itself. Null ids hash like any value.
An empty table has no shards. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources.tables import materialize

LIMIT = 64 << 20
HALF = 60
OVERHEAD = 16
MOST_BROADCAST = 1 << 16
_OWN = ("h", "t", "bytes", "entry", "shard", "n_rows", "n_bytes", "p", "q")


def _prefix(depth: int) -> tuple[Column, Column]:
    """The first `depth` bits of the key (h, t), as two numbers."""
    none = F.lit(0).cast("long")
    if depth <= HALF:
        return (F.shiftright("h", HALF - depth) if depth else none), none
    return F.col("h"), F.shiftright("t", 2 * HALF - depth)


def keys(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """All columns, h and t (the key) and bytes of every row."""
    name = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    place = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    number = lambda digest: F.conv(F.substring(digest, 1, HALF // 4), 16, 10).cast("long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead
    return docs.select("*", number(name).alias("h"), number(place).alias("t"), size.alias("bytes"))


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """depth, p, q (the prefix), shard (its bits as text), n_bytes, n_rows of every shard, from rows with h, t, bytes."""
    left = materialize(rows.select("h", "t", "bytes"), "shard-keys")
    made: DataFrame | None = None
    for depth in range(2 * HALF + 1):
        p, q = _prefix(depth)
        sums = left.groupBy(p.alias("p"), q.alias("q")).agg(F.sum("bytes").alias("n_bytes"), F.count("*").alias("n_rows"))
        sums = materialize(sums, "shard-level")
        fits = (F.col("n_bytes") <= limit) | (F.col("n_rows") == 1) | F.lit(depth == 2 * HALF)
        level = sums.where(fits).select(F.lit(depth).alias("depth"), "p", "q", "n_bytes", "n_rows")
        made = level if made is None else made.unionByName(level)
        over = sums.where(~fits).select("p", "q")
        if over.isEmpty():
            break
        if not level.isEmpty():  # else every prefix splits and all keys go on
            left = materialize(left.withColumns({"p": p, "q": q}).join(over, ["p", "q"], "left_semi").drop("p", "q"), "shard-left")
    high = F.least(F.col("depth"), F.lit(HALF))
    bits = lambda value, n: F.when(n > 0, F.lpad(F.bin(value), n, "0")).otherwise("")
    return materialize(made.withColumn("shard", F.concat(bits("p", high), bits("q", F.col("depth") - HALF))), "shard-directory")


def assign(rows: DataFrame, shards: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Rows with the `shard`, n_bytes and n_rows of their key's prefix."""
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())
    about = ["shard", "n_bytes", "n_rows"]
    if depths and depths[-1] <= 30:
        # the directory: a shard of fewer bits owns each entry that begins with them
        spare = F.expr(f"shiftleft(1L, {depths[-1]} - depth)")
        entries = shards.select(F.explode(F.sequence(F.col("p") * spare, (F.col("p") + 1) * spare - 1)).alias("entry"), *about)
        entries = F.broadcast(entries) if 2 ** depths[-1] <= most_broadcast else entries
        return rows.withColumn("entry", _prefix(depths[-1])[0]).join(entries, "entry").drop("entry")
    out = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("shard", "string"), ("n_bytes", "long"), ("n_rows", "long"))}).where("false")
    for depth in depths:  # exact repeats of a row made the directory deep: a join for each depth in use
        p, q = _prefix(depth)
        mine = shards.where(F.col("depth") == depth).select("p", "q", *about)
        out = out.unionByName(rows.withColumns({"p": p, "q": q}).join(mine, ["p", "q"]).drop("p", "q"))
    return out


def shard_documents(docs: DataFrame, limit: int = LIMIT, overhead: int = OVERHEAD) -> DataFrame:
    """All columns of docs, then shard, n_bytes and n_rows; a column of docs with one of these names gets the prefix own_ (again, if taken)."""
    clash, taken = {}, {c.lower() for c in docs.columns} | set(_OWN)
    for c in (c for c in docs.columns if c.lower() in _OWN):
        clash[c] = f"own_{c}"
        while clash[c].lower() in taken:
            clash[c] = f"own_{clash[c]}"
        taken.add(clash[c].lower())
    rows = keys(docs.withColumnsRenamed(clash), overhead)
    shards = directory(rows, limit)
    if not shards.where(F.col("depth") > HALF).isEmpty():  # places in the input count: they are written once
        rows = materialize(rows, "shard-rows")
        shards = directory(rows, limit)
    out = assign(rows, shards).drop("h", "t", "bytes")
    return out.withColumnsRenamed({v: k for k, v in clash.items() if k.lower() not in ("shard", "n_bytes", "n_rows")})


def sql(limit: int = LIMIT, overhead: int = OVERHEAD, deepest: int = 24) -> str:
    """DuckDB form for tables without repeated rows larger than the limit."""
    return f"""
WITH k AS (
  SELECT doc_id, CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS h,
         coalesce(strlen(text), 0) + {overhead} AS bytes FROM documents),
levels AS (
  SELECT d.depth, k.h >> (60 - d.depth) AS p, CAST(sum(bytes) AS BIGINT) AS n_bytes, count(*) AS n_rows
  FROM k CROSS JOIN (SELECT unnest(range(0, {deepest + 1})) AS depth) d GROUP BY ALL),
shards AS (
  SELECT a.* FROM levels a LEFT JOIN levels b ON b.depth = a.depth - 1 AND b.p = a.p >> 1
  WHERE (a.n_bytes <= {limit} OR a.n_rows = 1) AND (a.depth = 0 OR (b.n_bytes > {limit} AND b.n_rows > 1)))
SELECT k.doc_id, CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(s.p), CAST(s.depth AS INTEGER), '0') END AS shard, s.n_bytes, s.n_rows
FROM k JOIN shards s ON s.p = k.h >> (60 - s.depth)
"""
