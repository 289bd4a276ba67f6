"""Spelling variants: words one edit apart, found by PartEnum signatures.

1. Runs of Latin letters become words; one run in 31, chosen by a hash of its document
   and itself, loses a letter (a planted slip). Words of at least 7 letters that occur
   twice or more are the vocabulary, with their counts.
2. A word's letters are a multiset, seen as a binary vector whose dimensions are (letter,
   how many-th of its kind). One inserted or deleted letter changes one dimension, a
   replaced one changes two. The dimensions are dealt out to `PARTS` parts; words that
   differ in one dimension (in two) agree in all parts but one (but two), so that a word
   has a signature for every choice of one (of two) parts left out, and near words share one.
3. Signatures are equi-joined with the length, and, as one edit leaves one half of a word
   as it is, with either half: anagrams, of which a vocabulary has many, don't all meet.
   Candidates are verified exactly inside the join; a pair counts at the first signature
   that it shares, so that it comes out once.
4. A word's form is its most frequent near word, if that is ten times as frequent. Counts
   rise tenfold at each step, which bounds the steps to the root; links are doubled.

Work after the count grows with the vocabulary, not with the texts; a word's near words
are bounded by its length and the alphabet.

Defined results. A null text has no words; a null doc_id counts as an empty one in the
hash. Repeated rows count each time. An empty table has no words. Extra columns are
ignored. A run without any letter left after its slip is no word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import words as W
from evenkeel.sources.tables import materialize

LEAST_LETTERS = 7
LEAST_COUNT = 2
SLIP_EVERY = 31
TIMES = 10
PARTS = 3
BITS = 20
#: Texts are counted in slices of about so many bytes.
SLICE = 4_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray, longest: int = 64) -> np.ndarray:
    """crc32 of each span, going on from the crc `begun`."""
    out = begun.astype(np.uint32)
    size = end - start
    for i in np.flatnonzero(size > longest):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(out[i]))
    short = np.flatnonzero(size <= longest)
    short = short[np.argsort(-size[short], kind="stable")]
    many = np.searchsorted(-size[short], -np.arange(1, longest + 1), "right")  # spans with so many bytes at least
    state, at = ~out[short], start[short]
    for k, n in enumerate(many):
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[short] = ~state
    return out


def count_words(doc_ids: list[str], data: np.ndarray, edges: np.ndarray, least: int = LEAST_LETTERS) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of at least `least` letters in some texts, slips made, and how often each occurs."""
    data = W.LOWER[data]
    lead = data == 0xC3  # of the two bytes of a letter beyond ASCII
    inside = _LETTER[data]
    inside[1:] |= lead[:-1]
    start, end = W.spans(inside, edges)
    leads = np.concatenate([[0], np.cumsum(lead)])
    letters = end - start - (leads[end] - leads[start])
    start, end, letters = (x[letters >= least] for x in (start, end, letters))
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in doc_ids], dtype=np.uint32)
    crc = crc32(data, start, end, begun[np.searchsorted(edges, start, "right") - 1])
    slips = (crc % SLIP_EVERY == 0) if len(crc) else np.empty(0, dtype=bool)
    made: dict[bytes, int] = {}
    for a, b, n, h in zip(start[slips], end[slips], letters[slips], crc[slips]):
        if n > least:
            word, at = data[a:b].tobytes().decode(), int(h) % int(n)
            word = (word[:at] + word[at + 1 :]).encode()
            made[word] = made.get(word, 0) + 1
    start, end = start[~slips], end[~slips]
    _, first, times = np.unique(W.spans_hash(W._BYTE_KEYS[data], start, end, W._BYTE_BASE), return_index=True, return_counts=True)
    words = [data[a:b].tobytes() for a, b in zip(start[first], end[first])]
    return words + list(made), np.concatenate([times, np.fromiter(made.values(), np.int64, len(made))]).astype(np.int64)


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of every word that occurs often enough."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text", SLICE):
                words, n = count_words(part.column("doc_id").to_pylist(), data, edges, least)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["word", "n"])

    counts = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def prints(words: pa.Array, parts: int = PARTS, bits: int = BITS) -> np.ndarray:
    """Each word's letters as one number: for each part, `bits` bits of the sum of its dimensions' hashes."""
    data, edges = W.texts(words)
    inner = (data & 0xC0) == 0x80
    letter = data.astype(np.int64)
    letter[:-1] |= np.where(inner[1:], data[1:].astype(np.int64) << 8, 0)
    at = np.flatnonzero(~inner)
    word = np.searchsorted(edges, at, "right") - 1
    kind = (word << 16) | letter[at]
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.empty(0, dtype=np.int64)
    nth = np.arange(len(kind)) - np.repeat(first, np.diff(np.append(first, len(kind))))
    hashed = W.mix(((kind & 0xFFFF) << 32 | nth).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    part = (hashed >> np.uint64(40)) % np.uint64(parts)
    cell = (kind >> 16) * parts + part.astype(np.int64)
    sums = np.zeros(len(words) * parts, dtype=np.int64)
    np.add.at(sums, cell, (hashed & np.uint64(2**bits - 1)).astype(np.int64))
    sums = (sums & (2**bits - 1)).reshape(len(words), parts)
    return (sums << (bits * np.arange(parts))).sum(axis=1)


def _choices(left_out: int, parts: int, bits: int) -> list[tuple[tuple[int, ...], int]]:
    """Each choice of parts to leave out, and the mask of the print's other bits."""
    part = lambda p: (2**bits - 1) << (bits * p)
    return [(gone, sum(part(p) for p in range(parts) if p not in gone)) for gone in combinations(range(parts), left_out)]


def _halves(size: Column, left_out: int) -> tuple[Column, Column]:
    """Letters of the first and of the last half; one edit leaves one of them as it is."""
    last = ((size + 1) / 2).cast("int")
    return (size / 2).cast("int") if left_out == 2 else last, last


def signatures(known: DataFrame, left_out: int, longer: int = 0, parts: int = PARTS, bits: int = BITS) -> DataFrame:
    """Words (word, n, print) under each signature: size, choice, letters and rest.

    A choice leaves out so many of the parts, and goes with one half of the word; size is the
    length of the shorter word of a pair, which this one exceeds by `longer` letters.
    """
    size = F.char_length("word") - longer
    first, last = _halves(size, left_out)
    each = [
        F.struct(F.lit(2 * k + side).alias("choice"), letters.alias("letters"), F.col("print").bitwiseAND(F.lit(mask)).alias("rest"))
        for k, (_, mask) in enumerate(_choices(left_out, parts, bits))
        for side, letters in enumerate((F.left("word", first), F.right("word", last)))
    ]
    return known.select("word", "n", "print", size.alias("size"), F.explode(F.array(*each)).alias("at")).select("size", "at.*", "word", "n", "print")


def _meet(known: DataFrame, left_out: int, parts: int, bits: int) -> DataFrame:
    """Pairs of words under a signature in common, at the first one only, verified."""
    keys = ["size", "choice", "letters", "rest"]
    side = lambda x, longer: signatures(known, left_out, longer, parts, bits).select(*keys, F.col("word").alias(x), F.col("n").alias(f"{x}_n"), F.col("print").alias(f"{x}_print"))
    differ = F.col("a_print").bitwiseXOR(F.col("b_print"))
    first = None  # of the choices that leave out all parts in which the two differ
    for k, (_, mask) in enumerate(_choices(left_out, parts, bits)):
        fits = differ.bitwiseAND(F.lit(mask)) == 0
        first = F.when(fits, k) if first is None else first.when(fits, k)
    half = _halves(F.col("size"), left_out)[0]
    new = (F.col("choice") % 2 == 0) | (F.left("a", half) != F.left("b", half))
    order = F.col("a") < F.col("b") if left_out == 2 else F.lit(True)
    met = side("a", 0).join(side("b", 2 - left_out), keys)
    return met.where(order & (F.shiftright(F.col("choice"), 1) == first) & new & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "a_n", "b_n")


def near_words(vocab: DataFrame, parts: int = PARTS, bits: int = BITS) -> DataFrame:
    """a, b, a_n, b_n of every two words one edit apart, once for each pair.

    Words of one length differ by a replaced letter (two dimensions), others by one more
    letter in the longer (one dimension).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("print", pa.array(prints(batch.column("word"), parts, bits)))

    known = vocab.select("word", "n").mapInArrow(run, "word string, n long, print long")
    return _meet(known, 2, parts, bits).unionByName(_meet(known, 1, parts, bits))


def forms(vocab: DataFrame, near: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n of every word of the vocabulary."""
    none = {"other": F.lit(None).cast("string"), "other_n": F.lit(None).cast("long")}
    sides = [near.select(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")]
    rows = vocab.select("word", "n").withColumns(none).unionByName(sides[0]).unionByName(sides[1])
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    much = -F.col("best.less") >= times * F.col("n")
    return found.select("word", "n", "n_near", F.when(much, F.col("best.word")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame, times: int = TIMES) -> DataFrame:
    """word and root of the words that have a form: forms followed to the last."""
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("n")).first()[0] or 1
    steps = max(1, ceil(log(most) / log(times)))
    for _ in range(steps.bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
    return links


def variants(docs: DataFrame, parts: int = PARTS, bits: int = BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = materialize(vocabulary(docs), "spelling-words")
    found = materialize(forms(vocab, near_words(vocab, parts, bits)), "spelling-forms")
    ends = found.join(roots(found), "word", "left")
    return ends.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = SLIP_EVERY, times: int = TIMES, steps: int = 8) -> str:
    """DuckDB form: near words meet under what is left when one letter is deleted."""
    follow = "".join(f", r{k + 1} AS (SELECT r.word, coalesce(f.form, r.root) AS root FROM r{k} r LEFT JOIN f ON f.word = r.root)" for k in range(steps))
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
many AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {least} GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM many),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)]))) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= {least} GROUP BY word HAVING sum(k) >= {least_count}),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
c AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cut),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, v.word, v.n FROM c JOIN v ON v.word = c.rest UNION SELECT v.word, v.n, c.word, c.n FROM c JOIN v ON v.word = c.rest),
best AS (SELECT word, max(n) AS n, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
f AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= {times} * n),
r0 AS (SELECT word, word AS root FROM v){follow}
SELECT v.word, f.form, r.root, v.n, coalesce(best.n_near, 0) AS n_near, f.form_n
FROM v JOIN r{steps} r ON r.word = v.word LEFT JOIN best ON best.word = v.word LEFT JOIN f ON f.word = v.word
"""
