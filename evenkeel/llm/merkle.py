"""Merkle manifest of a dataset: every row can be proven to be part of it, or shown to be altered.

A row's leaf is a hash of its columns. Leaves of one source, in order of doc_id, form a
tree of runs of 16; the sources' roots form another tree of the same kind, whose root
stands for the dataset.

1. Leaves are hashed by Spark expressions and written without texts. They are numbered
   within their tree by sorted ranges of all tasks, so that a large source is no large task.
2. Up: a superblock of 16**3 consecutive nodes becomes one node of the next stage; a few
   stages lead to any root.
3. Down: members of a superblock are cogrouped with its outer nodes (the siblings on the way
   from the superblock to the root). One applyInPandas reduces the members again, joins
   their proofs with the outer ones, and hands them to the next stage below; at the leaves
   it folds each leaf, as it is now, into the root that its proof gives.

A superblock has at most 4,096 short rows, whatever the size of its source, and its outer
nodes are 15 a level at most. Numbers of stages follow the logarithm of the input.

Defined results. Nulls are told apart from empty values; a null doc_id comes first in its
source, a null source first of all. Rows with one doc_id are ordered by their leaves, so
that repeated rows get the same digests in some order. A null doc_id is never tampered
with. A source with one row has its leaf as root. An empty table has no rows, and no root.
Extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.sources.tables import materialize

RUN = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUTER = "tree string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


def leaf(fields: dict[str, Column]) -> Column:
    """Hash of the fields: `-` for a null, else the bytes' number, a colon and the value."""
    told = []
    for value in fields.values():
        text = value.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and now (the leaf of the row as it is today; null: as it was)."""
    fields = {c: F.col(c) for c in FIELDS}
    now = leaf(fields | {"text": F.translate("text", UPPER, LOWER)})
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # sorts as sources do, null first
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("node"), F.when(tampered(F.col("doc_id")), now).alias("now"))


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with pos, their place within `tree` from 0, and n, the size of the tree."""
    at = {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}
    ranked = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy("tree", *order, "_tie").drop("_tie").withColumns(at), "merkle-ranked")
    pieces = ranked.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    tree = Window.partitionBy("tree")  # a row for each task that holds some of the tree
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("n"))
    return ranked.join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def height(n: int, run: int = RUN) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // run), levels + 1
    return levels


def reduced(nodes: list[str], levels: int, run: int = RUN) -> list[list[str]]:
    """The nodes of each level, from the given ones upwards."""
    rows = [nodes]
    for _ in range(levels):
        last = rows[-1]
        rows.append([sha256("".join(last[k : k + run]).encode()).hexdigest() for k in range(0, len(last), run)])
    return rows


def path(rows: list[list[str]], at: int, run: int = RUN) -> tuple[list[str], list[str]]:
    """Siblings left and right of a node's ancestors, level by level, below the last row."""
    lefts, rights = [], []
    for row in rows[:-1]:
        begin = at - at % run
        lefts.append("".join(row[begin:at]))
        rights.append("".join(row[at + 1 : begin + run]))
        at //= run
    return lefts, rights


def fold(node: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        node = sha256((left + node + right).encode()).hexdigest()
    return node


def _block(run: int, levels: int) -> Column:
    return F.floor(F.col("pos") / run**levels).cast("long").alias("block")


def up(nodes: DataFrame, run: int = RUN, levels: int = LEVELS) -> list[DataFrame]:
    """Stages of the trees in nodes (tree, pos, n, node): the given one, then a node for each superblock, until each tree has one."""
    stages = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n, first = int(rows["n"].iloc[0]), int(rows["pos"].iloc[0])
        top = reduced(rows["node"].tolist(), min(levels, height(n, run)), run)[-1]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1].tolist(), "pos": [first // run**levels], "n": [-(-n // run**levels)], "node": top})

    while most > 1:
        below = stages[-1].select("tree", "pos", "n", "node", _block(run, levels))
        stages.append(materialize(below.groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, n long, node string"), "merkle-stage"))
        most = -(-most // run**levels)
    return stages


def _with_outer(nodes: DataFrame, outer: DataFrame, run: int, levels: int):
    """Nodes, cogrouped by superblock with its outer nodes."""
    members = nodes.withColumn("block", _block(run, levels)).groupBy("tree", "block")
    return members.cogroup(outer.withColumn("block", F.col("pos")).groupBy("tree", "block"))


def _paths(rows: pd.DataFrame, run: int, levels: int) -> list[tuple[list[str], list[str]]]:
    """For each member of a superblock, in order, its siblings up to the superblock's node."""
    part = reduced(rows["node"].tolist(), min(levels, height(int(rows["n"].iloc[0]), run)), run)
    return [path(part, k, run) for k in range(len(rows))]


def exchange(nodes: DataFrame, outer: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """Outer nodes of every node, from those of its superblock; a node with a `name` is the root of the tree so named."""

    def join(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, above = rows.sort_values("pos"), above.iloc[0]
        mine = _paths(rows, run, levels)
        sides = {"lefts": [[*p[0], *above["lefts"]] for p in mine], "rights": [[*p[1], *above["rights"]] for p in mine]}
        if "name" in rows:
            place = {"tree": rows["name"].tolist(), "pos": 0, "subroot": rows["node"].tolist()}
        else:
            place = {"tree": rows["tree"].tolist(), "pos": rows["pos"].tolist(), "subroot": above["subroot"]}
        return pd.DataFrame(sides | place | {"root": above["root"]})

    return materialize(_with_outer(nodes, outer, run, levels).applyInPandas(join, _OUTER), "merkle-outer")


def down(stages: list[DataFrame], outer: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """Outer nodes of the superblocks of the first stage, from those of the last."""
    for stage in stages[-2:0:-1]:
        outer = exchange(stage, outer, run, levels)
    return outer


def verify(rows: DataFrame, outer: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """doc_id and the digests of every leaf, from the outer nodes of its superblock."""

    def finish(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, above = rows.sort_values("pos"), above.iloc[0]
        rest = "".join(a + b for a, b in zip(above["lefts"], above["rights"]))
        leads_to: dict[str, str] = {}  # from what a superblock folds to
        proofs, folded = [], []
        for (lefts, rights), was, now in zip(_paths(rows, run, levels), rows["node"], rows["now"]):
            proofs.append(sha256(("".join(a + b for a, b in zip(lefts, rights)) + rest).encode()).hexdigest())
            node = fold(now if isinstance(now, str) else was, lefts, rights)
            if node not in leads_to:
                leads_to[node] = fold(node, above["lefts"], above["rights"])
            folded.append(leads_to[node])
        return pd.DataFrame({"doc_id": rows["doc_id"].tolist(), "leaf": rows["node"].tolist(), "subroot": above["subroot"], "root": above["root"], "proof_sha256": proofs, "folded_root": folded})

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # a null would turn numbers into doubles in pandas
    out = _with_outer(rows, outer, run, levels).applyInPandas(finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumns({"doc_id": F.col("doc_id").cast("long"), "verified": F.col("folded_root") == F.col("root")})


def manifest(docs: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = numbered(materialize(leaves(docs), "merkle-leaves"), F.col("doc_id").asc_nulls_first(), "node")
    stages = up(rows, run, levels)
    tops = numbered(stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "name")
    above = up(tops, run, levels)
    none = F.array().cast("array<string>")
    outer = materialize(above[-1].select("tree", "pos", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("node").alias("root")), "merkle-root")
    outer = exchange(tops, down(above, outer, run, levels), run, levels)
    return verify(rows, down(stages, outer, run, levels), run, levels)


def sql(run: int = RUN, deepest: int = 8) -> str:
    """DuckDB form; `deepest` bounds the levels of a tree."""
    told = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
    now = told.replace("CAST(text AS VARCHAR)", f"translate(text, '{UPPER}', '{LOWER}')")

    def tree(name: str) -> str:
        levels = [f"{name}0 AS (SELECT tree, pos, n, node, 0 AS level FROM {name})"]
        for k in range(deepest):
            levels.append(f"{name}{k + 1} AS (SELECT tree, pos // {run} AS pos, max((n + {run - 1}) // {run}) AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node, {k + 1} AS level FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        every = " UNION ALL ".join(f"FROM {name}{k}" for k in range(deepest + 1))
        side = lambda rows: f"coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, pos // {run} ORDER BY pos ROWS BETWEEN {rows}), '')"
        levels.append(f"{name}_all AS ({every}), {name}_side AS (SELECT *, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}_all)")
        return ",\n".join(levels)

    steps, cur = [], "f0"
    for k in range(2 * deepest):
        which, level, pos = ("s", k, "f.pos") if k < deepest else ("t", k - deepest, "f.top")
        name = "f.tree" if which == "s" else "''"
        steps.append(
            f"f{k + 1} AS (SELECT f.id, f.tree, f.pos, f.top, CASE WHEN x.node IS NULL THEN f.node ELSE sha256(x.l || f.node || x.r) END AS node, f.proof || coalesce(x.l || x.r, '') AS proof"
            f" FROM {cur} f LEFT JOIN {which}_side x ON x.tree = {name} AND x.level = {level} AND x.pos = {pos} // CAST({run**level} AS BIGINT) AND x.n > 1)"
        )
        cur = f"f{k + 1}"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({told}) AS node, sha256({now}) AS now, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents),
h AS (SELECT d.* EXCLUDE (x), xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)]))) AS h FROM d, crc),
s AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS id FROM h),
{tree("s")},
tops AS (SELECT tree AS name, node FROM s_all WHERE n = 1),
t AS (SELECT '' AS tree, name, node, row_number() OVER (ORDER BY encode(name)) - 1 AS pos, count(*) OVER () AS n FROM tops),
{tree("t")},
f0 AS (SELECT s.id, s.tree, s.pos, t.pos AS top, CASE WHEN h % 5 = 0 THEN now ELSE s.node END AS node, '' AS proof FROM s JOIN t ON t.name = s.tree),
{", ".join(steps)}
SELECT s.doc_id, s.node AS leaf, t.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM s JOIN t ON t.name = s.tree JOIN (SELECT node FROM t_all WHERE n = 1) r ON true JOIN {cur} f ON f.id = s.id
"""
