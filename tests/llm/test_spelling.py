"""Spelling variants against all pairs, and the parts of the method."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.llm import queries, spelling
from evenkeel.llm import words as W
from tests.compare import connection, same

DOC = "doc_id long, text string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute_vocabulary(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    vocab = brute_vocabulary(rows)
    near = defaultdict(list)
    for a, b in combinations(vocab, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in vocab.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-vocab[x], x))
            if vocab[best] >= 10 * n:
                form[w] = best
    out = {}
    for w, n in vocab.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), vocab[form[w]] if w in form else None)
    return out


def made_rows(seed):
    """Texts over few letters, so that anagrams and near words are many and counts span three steps of ten."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abéÿ"), rng.integers(6, 11))) for _ in range(90)]
    more = []
    for w in words[:40]:
        k = int(rng.integers(0, len(w)))
        more += [w[:k] + "a" + w[k:], w[:k] + "é" + w[k + 1 :], w[:k] + w[k + 1 :]]
    words += more + ["statement", "statemant", "statemint", "zstatemint", "a" * 300, "a" * 301]
    times = rng.integers(1, 4, len(words))
    times[-6:-2] = 3000, 400, 40, 2
    rows = [(int(k), " ".join([w.capitalize() if k % 3 else w] * int(n)) + ", x1Ā" + w) for k, (w, n) in enumerate(zip(words, times))]
    return rows + [(7, None), (8, ""), (None, "Variant variant variant"), (7, "repeated-row variants"), (7, "repeated-row variants")]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    rows = made_rows(seed)
    want = brute_variants(rows)
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("word", "n", "print", "form", "choice", "lang")})
    for parts, bits in ((3, 20), (4, 15), (5, 3)):  # too few bits only add candidates
        got = spelling.variants(docs, parts, bits).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(form for form, *_ in want.values()) and any(v[0] and v[0] != v[1] for v in want.values())


def test_whole_table_equals_its_sql(spark, data):
    same(queries.op11_spelling_variants(spark, data), connection(data), spelling.sql())


def test_no_rows_and_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOC)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a b c"), (2, None)], DOC)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abZéÿĀ -9", max_size=90), min_size=1, max_size=6), st.integers(0, 10**6))
def test_words_of_texts(texts, first):
    ids = [str(first + k) for k in range(len(texts))]
    words, n = spelling.count_words(ids, *W.texts(pa.array(texts, pa.string())), least=2)
    got = Counter()
    for w, k in zip(words, n):
        got[w.decode()] += int(k)
    want = Counter()
    for i, text in zip(ids, texts):
        for run in (r.translate(LOWER) for r in RUN.findall(text)):
            h = zlib.crc32(f"{i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want[word] += len(word) >= 2
    assert got == +want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcé", min_size=3, max_size=12), st.integers(0, 11), st.sampled_from("abcé"))
def test_one_edit_changes_one_or_two_dimensions(word, at, letter):
    at %= len(word)
    others = [word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]]
    here, longer, replaced = (int(x) for x in spelling.prints(pa.array([word, *others]), 6, 10))
    apart = lambda a, b: sum(((a ^ b) >> (10 * p)) & 1023 != 0 for p in range(6))
    assert apart(here, longer) <= 1 and apart(here, replaced) <= 2
    assert spelling.prints(pa.array([word]), 6, 10) == spelling.prints(pa.array(["".join(sorted(word))]), 6, 10)


def test_a_very_long_text_and_run(spark):
    long = ("information " * 200_000) + "q" * 1_500_000  # beyond a slice of texts
    got = {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame([(1, long), (2, "q" * 1_500_000)], DOC)).collect()}
    assert got == brute_vocabulary([(1, long), (2, "q" * 1_500_000)])
