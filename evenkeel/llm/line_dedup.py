"""Line dedup by a fixed-depth tree of log templates, in DataFrame functions only.

Lines go down a tree of fixed depth: first by their number of tokens, then by their
leading `depth` tokens (a token with a digit counts as the variable field `<*>`). Inside a
leaf a token stays in the template if `least_docs` or more documents of the leaf have it
at its position, and turns into `<*>` otherwise; a line whose template would keep less
than `least_constant` of its tokens is its own template. Templates found in `least_docs`
or more documents recur, and all of their lines are dropped.

Leaves are thinned first: only those with enough lines can hold a recurring template, and
only their lines, once per distinct line, have their tokens looked at. Sums by leaf, position
and token are partial before they meet; no leaf is gathered. A line goes through joins as two
64-bit hashes, of its leaf and of its masked text; the text itself is moved once, for each
distinct line.

Defined results. Lines end at a line feed; tokens are runs of non-space characters; lines
without tokens are never dropped and don't count. Null text has no lines. Rows are keyed
by doc_id and text, nulls included: repeated rows are one document and each get its
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources.tables import materialize

DEPTH, LEAST_DOCS, LEAST_CONSTANT = 3, 10, 0.7
FIELD = "<*>"
#: Leaves (8 bytes each) that may be broadcast; more are joined by shuffle.
MOST_BROADCAST = 1 << 20


def _has(text: Column, *marks: str) -> Column:
    found = F.lit(False)
    for mark in marks:
        found |= F.contains(text, F.lit(mark))
    return found


def lines_of(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, print, at, leaf, line (hash of masked), masked of every line with tokens.

    masked: the line's tokens joined by one space, those with a digit as a variable field.
    Texts and lines that need no rewriting are told apart by cheap scans first.
    """
    untidy = _has(F.col("text"), "\t", "\r", "\f", "\x0B", "  ")
    texts = docs.select(
        "doc_id",
        F.xxhash64("text").alias("print"),
        F.when(untidy, F.regexp_replace("text", r"[ \t\r\f\x0B]+", " ")).otherwise(F.col("text")).alias("text"),
    )
    cut = texts.select("doc_id", "print", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.trim("line")
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)
    rows = cut.select("doc_id", "print", "at", masked.alias("masked")).where("masked <> ''")
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))
    return rows.select("doc_id", "print", "at", F.xxhash64(n, F.substring_index("masked", " ", depth)).alias("leaf"), F.xxhash64("masked").alias("line"), "masked")


def _templates(lines: DataFrame, least_docs: int, least_constant: float) -> DataFrame:
    """leaf, line of each distinct line whose template recurs, from lines of leaves with enough lines."""
    in_docs = materialize(lines.select("leaf", "line", "doc_id", "print").distinct(), "line-docs")
    docs = in_docs.groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    distinct = materialize(lines.groupBy("leaf", "line").agg(F.min("masked").alias("masked")).join(docs, ["leaf", "line"]), "line-distinct")
    tokens = distinct.select("leaf", "line", "docs", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    common = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("leaf", "place", "token", F.lit(True).alias("stays"))
    marked = tokens.select("leaf", "line", "place", "token").join(common, ["leaf", "place", "token"], "left")
    field = F.coalesce(F.col("stays"), F.lit(False)) & (F.col("token") != FIELD)
    shaped = marked.groupBy("leaf", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.when(field, F.col("token")).otherwise(FIELD).alias("token")))), lambda p: p["token"]), " ").alias("general"),
        F.avg(field.cast("int")).alias("constant"),
    )
    shaped = materialize(shaped.select("leaf", "line", F.when(F.col("constant") >= least_constant, F.xxhash64("general")).otherwise(F.col("line")).alias("template")), "line-templates")
    seen = in_docs.join(shaped, ["leaf", "line"]).select("leaf", "template", "doc_id", "print").distinct()
    recurring = seen.groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("leaf", "template")
    return materialize(shaped.join(recurring, ["leaf", "template"], "left_semi").select("leaf", "line"), "line-recurring")


def recurring_lines(docs: DataFrame, depth: int = DEPTH, least_docs: int = LEAST_DOCS, least_constant: float = LEAST_CONSTANT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, print, at of every line of a recurring template."""
    every = lines_of(docs, depth)
    full = materialize(every.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= least_docs).select("leaf"), "line-leaves")
    some = materialize(every.join(F.broadcast(full) if full.count() <= most_broadcast else full, "leaf"), "line-candidates")
    return some.select("doc_id", "print", "at", "leaf", "line").join(_templates(some, least_docs, least_constant), ["leaf", "line"], "left_semi").select("doc_id", "print", "at")


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines (with tokens), n_dropped and kept_text of every row."""
    docs = docs.select("doc_id", "text")
    gone = recurring_lines(docs, **how).groupBy("doc_id", "print").agg(F.collect_set("at").alias("gone")).select(F.col("doc_id").alias("of"), F.col("print").alias("of_print"), "gone")
    rows = docs.withColumn("print", F.xxhash64("text"))
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("print").eqNullSafe(F.col("of_print")), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains("gone", at)), "\n")
    return both.select(
        "doc_id",
        F.coalesce(F.size(F.filter(lines, lambda line: line.rlike(r"[^ \t\r\f\x0B]"))), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("kept_text"),
    )


def sql(depth: int = DEPTH, least_docs: int = LEAST_DOCS, least_constant: float = LEAST_CONSTANT) -> str:
    """DuckDB form of the query over `drop_lines`."""
    return rf"""
WITH d AS (SELECT doc_id, text, md5(coalesce(text, '')) AS print, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, print, unnest(lines) AS line, unnest(range(len(lines))) AS nr FROM d),
m AS (SELECT doc_id, print, nr, regexp_replace(regexp_replace(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'), '^ | $', '', 'g'), '[^ ]*[0-9][^ ]*', '{FIELD}', 'g') AS masked FROM x),
l AS (SELECT DISTINCT *, string_split(masked, ' ') AS tokens FROM m WHERE masked <> ''),
f AS (SELECT *, len(tokens) || '|' || array_to_string(tokens[1:{depth}], ' ') AS leaf FROM l),
i AS (SELECT DISTINCT doc_id, print, leaf, masked, tokens FROM f),
u AS (SELECT leaf, masked, tokens, count(*) AS docs FROM i GROUP BY ALL),
t AS (SELECT leaf, masked, docs, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM u),
c AS (SELECT leaf, place, token FROM t GROUP BY ALL HAVING sum(docs) >= {least_docs}),
g AS (SELECT t.leaf, t.masked, string_agg(CASE WHEN c.leaf IS NOT NULL THEN t.token ELSE '{FIELD}' END, ' ' ORDER BY t.place) AS general,
  avg(CASE WHEN c.leaf IS NOT NULL AND t.token <> '{FIELD}' THEN 1 ELSE 0 END) AS constant
  FROM t LEFT JOIN c ON c.leaf = t.leaf AND c.place = t.place AND c.token = t.token GROUP BY ALL),
s AS (SELECT leaf, masked, CASE WHEN constant >= {least_constant} THEN general ELSE masked END AS template FROM g),
r AS (SELECT s.leaf, s.template FROM i JOIN s USING (leaf, masked) GROUP BY ALL HAVING count(DISTINCT (i.doc_id, i.print)) >= {least_docs}),
z AS (SELECT f.doc_id, f.print, list(f.nr) AS gone FROM f JOIN s USING (leaf, masked) JOIN r USING (leaf, template) GROUP BY ALL)
SELECT d.doc_id, CAST(len(list_filter(coalesce(d.lines, []), lambda q: regexp_matches(q, '[^ \t\r\f\v]'))) AS BIGINT) AS n_lines,
  CAST(coalesce(len(z.gone), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN z.gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(d.lines)), lambda k: NOT list_contains(z.gone, k)), lambda k: d.lines[k + 1]), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN z ON z.doc_id IS NOT DISTINCT FROM d.doc_id AND z.print = d.print
"""
