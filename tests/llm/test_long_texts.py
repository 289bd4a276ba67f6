"""Texts beyond a batch's slice (CHUNK_BYTES), for each of the first ten operators."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import chat_format, decontamination, line_dedup, minhash_dedup, mixing, quality_rules, sharding, substring_dedup, toxicity, url_filter
from evenkeel.llm import words as W
from tests.llm.test_operators import brute_leaks, brute_repeats, brute_statistics, plain_cells, words


@pytest.fixture(scope="module")
def rows():
    """Short texts before, between and after long ones; the second long one is a near copy of the first."""
    rng = np.random.default_rng(11)
    long = ["".join(rng.choice(list("abcdefghé"), rng.integers(3, 9))) for _ in range(260_000)]
    for at in range(8, len(long), 9):
        long[at] += "\n"
    near = [w if k % 50_000 else "changed" for k, w in enumerate(long)]
    other = ["".join(rng.choice(list("ijklmn#"), 6)) for _ in range(200_000)] + long[:60]
    texts = ["short one", " ".join(long), "", " ".join(near), None, " ".join(other), "idiot scum " * 9]
    assert sum(len((t or "").encode()) > W.CHUNK_BYTES for t in texts) == 3
    return [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_statistics(docs):
    for r in quality_rules.statistics(docs, ["doc_id", "text"]).collect():
        assert tuple(r.stats)[:5] == brute_statistics(r.text)


def test_repeats(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("sha")).collect()}
    assert got == brute_repeats([r[:2] for r in rows])
    assert got[3][1] > 250_000 and got[5][1] >= 60 - 1


def test_conversation(spark, rows):
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", r[1]) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string")
    said = "".join(r[1] or "" for k, r in enumerate(rows) if k % 2)
    row = chat_format.digest(df).first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(rows), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_mixing_and_sharding(docs, rows):
    weighed = {r.doc_id: r for r in mixing.weigh(docs).collect()}
    assert set(weighed) == set(range(len(rows)))
    out = {r.doc_id: r for r in sharding.shard_documents(docs, limit=4 << 20).collect()}
    assert set(out) == set(range(len(rows)))
    size = lambda k: len((rows[k][1] or "").encode()) + sharding.OVERHEAD
    for k in out:
        assert out[k].n_bytes == sum(size(j) for j in out if out[j].shard == out[k].shard)


def test_urls(spark):
    url = "http://www.long.de/" + "x" * 1_200_000
    pages = spark.createDataFrame([(1, url, "h"), (2, url.replace("www.", "m.") + ".html", "h"), (3, url + "y", "#" * 1_200_000)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.listed_urls(pages, ())).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block"}


def test_toxic_features(rows):
    import pyarrow as pa

    text = rows[5][1][:1_500_000]
    _, cells, count = toxicity.features(*W.texts(pa.array([text])))
    assert (set(cells.tolist()), int(count[0])) == plain_cells(text)


def test_lines(docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(docs).collect()}
    assert got[1][0] == 28_889 and got[1][1] == 0 and set(got) == set(range(7))


def test_leaks(spark, docs, rows):
    item = " ".join(words(rows[1][1])[150_000:150_012])
    many = " ".join(words(rows[5][1])[1_000:5_000])
    items = spark.createDataFrame([(1, item), (2, many)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontamination.inspect(docs, items).collect()}
    assert sorted(((k, *v[:3]) for k, v in got.items()), key=repr) == brute_leaks([r[:2] for r in rows], [(1, item), (2, many)])
    assert got[1][1] == 12 and got[5][3]


def test_near_copies(docs):
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(docs).collect()}
    assert got[1] == got[3] and len({got[k] for k in (1, 5, 6)}) == 3
