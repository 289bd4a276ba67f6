"""The Merkle manifest against a plain tree, and what it says of altered rows."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import merkle, queries
from tests.compare import connection, same

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, run):
    """The levels of a plain tree."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        last = rows[-1]
        rows.append([hashed(*last[k : k + run]) for k in range(0, len(last), run)])
    return rows


def way(rows, at, run):
    out = []
    for row in rows[:-1]:
        begin = at // run * run
        out.append((row[begin:at], row[at + 1 : begin + run]))
        at //= run
    return out


def brute(rows, run):
    leaf = lambda r, text: hashed(told(r[0]), told(r[3]), told(r[2]), told(r[4]), told(text))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    per = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: tree([leaf(r, r[1]) for r in per[s]], run) for s in sources}
    top = tree([trees[s][-1][0] for s in sources], run)
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(per[s]):
            siblings = way(trees[s], at, run) + way(top, k, run)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate(LOWER)
            node = leaf(r, text)
            for left, right in siblings:
                node = hashed(*left, node, *right)
            out.append((r[0], trees[s][0][at], trees[s][-1][0], top[-1][0], hashed(*(x for left, right in siblings for x in left + right)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def made_rows(n, sources):
    rows = [(k, f"Text {k}" if k % 3 else f"text {k} é\U0001f600", "en" if k % 4 else None, None if k % sources == 0 else f"s{k % sources}", k) for k in range(n)]
    return rows + [(None, "No id", "en", "s1", 1), (2**60 + 1, "Long id", "en", "s1", None), (2**60 + 3, "Long Id", "en", "s1", None), (5, "A", "en", "", 1), (6, None, None, None, None), (9, "twice", "en", "s2", 2), (9, "twice", "en", "s2", 2), (9, "Again", "en", "s2", 2)]


@pytest.mark.parametrize(("n", "sources", "run", "levels"), [(40, 3, 2, 1), (300, 2, 3, 2), (150, 60, 2, 3), (90, 4, 16, 3)])
def test_digests_equal_a_plain_tree(spark, n, sources, run, levels):
    rows = made_rows(n, sources)
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("tree", "pos", "node", "now", "name", "block", "root")}).repartition(5)
    got = merkle.manifest(docs, run, levels).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, run)
    assert {r.verified for r in got} == {True, False}


def test_a_single_row_and_none(spark):
    one = [(1, "Some", "en", "s", 4)]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(one, DOC)).collect()] == brute(one, 16)
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0


def test_a_long_text_and_one_source(spark):
    rows = [(k, "Ab " * 500_000 if k == 3 else "x", "en", "s", k) for k in range(20)]
    assert sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOC)).collect()), key=repr) == brute(rows, 16)


def test_whole_table_equals_its_sql(spark, data):
    same(queries.op12_merkle_manifest(spark, data), connection(data), merkle.sql())
