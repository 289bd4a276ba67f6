"""Near-duplicates by improved consistent weighted sampling of TF-IDF shingles.

1. A shingle of five words weighs tf * (1 + damping * idf). idf is clipped and depends on the
   share of documents that hold the shingle alone: 1 up to a share of `common` (1 in 100),
   from there ln(share) / ln(common), down to 0 for a shingle of all documents. Shingles above
   that share are few whatever the size of the corpus (at most the mean number of shingles of
   a text over `common`); they are counted exactly, after a sketch has named the cells they
   may lie in, and broadcast.
2. Improved consistent weighted sampling (Ioffe 2010) gives each text `bands * rows` samples
   whose chance to agree is the weighted Jaccard similarity; the samples of a band make its
   key. Keys are refined by size class: texts whose total weights differ too much can't be
   similar, so a passage that very different texts share doesn't pair them.
3. Texts with the same words collapse to one representative by a grouped 128-bit hash; only
   representatives are compared.
4. Texts of one key are candidates. Two rounds verify a key's members against pivots (one,
   then up to two outside the key's largest class), pair by pair, by exact weighted Jaccard
   similarity. Classes (connected components of the verified links) are brought up to date
   after each round, and only keys whose members lie in different classes go on. What is
   left, members that no pivot settled against members of other classes, is verified in
   blocks of texts, `BLOCK_BYTES` each: keys that join the same blocks count once, and each
   two blocks that share a key meet once. So a large group of copies costs about one pair for
   each member and key, its outliers are still held against all others, and no group meets
   in one task.
5. Components are found by large-star and small-star rounds, all in joins.

Words are as in substring dedup, with A-Z lower-cased. A text of one to four words is one
shingle. Defined results: null texts and texts without words are alone in their class.
A row is a document, named by doc_id and a hash of its text: rows that share a doc_id (or have
none) but not the text are told apart, rows that share both share their result. A class is
named by its least doc_id; one without any doc_id has a null name. Extra columns are ignored
or, in `drop_near_duplicates`, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import words as W
from evenkeel.sources.tables import materialize

SHINGLE, LIMIT = 5, 0.8
BANDS, ROWS = 12, 4
SKETCH_CELLS = 1 << 18
DAMPING, COMMON = 0.25, 0.01
#: Text of a block, on average; a longer text is a block of its own size.
BLOCK_BYTES = 400_000
#: Rows of numbers up to which a table is worked on in one task, without shuffles.
SMALL = 200_000
_STEPS = 1 << 14


def shingles(words: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; a text of fewer than n words but one is a single one."""
    at = words.windows(n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    doc = np.concatenate([words.doc[at], short])
    start = np.concatenate([at, words.first[short]])
    end = np.concatenate([at + n, words.first[short + 1]])
    return doc, words.span_hashes(start, end)


def counted(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order of text, and how often each occurs."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    lead = np.flatnonzero(fresh)
    return doc[lead], keys[lead], np.diff(np.append(lead, len(doc)))


def _cell(keys: np.ndarray, cells: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)


class Weights:
    """TF-IDF weights over n texts: `keys` (sorted) are the shingles of `df` texts, more than a share of `common`."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int, damping: float, common: float):
        self.keys, self.rare = keys, 1 + damping
        self.factor = 1 + damping * np.log(np.maximum(n, 1) / df) / -math.log(common)

    def of(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.rare * times
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.factor[at], self.rare) * times


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), as r and as ln c, for 14 random bits."""
    u = (np.arange(_STEPS) + 0.5) / _STEPS
    x = np.full(_STEPS, 2.0)
    low, high = np.zeros(_STEPS), np.full(_STEPS, 60.0)
    for _ in range(60):  # 1 - (1 + x) exp(-x) = u by bisection
        x = (low + high) / 2
        over = 1 - (1 + x) * np.exp(-x) > u
        low, high = np.where(over, low, x), np.where(over, x, high)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_R, _LN_C = _tables()


def band_keys(doc: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """n x bands band keys of texts whose shingles stand together in order of text."""
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, dtype=np.int64)
    size = np.diff(np.append(begin, len(doc)))
    of = np.repeat(np.arange(len(begin)), size)
    ln_w = np.log(weights).astype(np.float32)
    out = np.zeros((n, bands), dtype=np.uint64)
    if not len(doc):
        return out
    for band in range(bands):
        made = np.full(len(begin), band + 1, dtype=np.uint64)
        for row in range(rows):
            bits = W.mix(keys ^ np.uint64((band * rows + row + 1) * 0x9E3779B97F4A7C15 % 2**64))
            r = _R[bits & np.uint64(_STEPS - 1)]
            beta = ((bits >> np.uint64(14)) & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(2.0**-20)
            t = np.floor(ln_w / r + beta)
            ln_a = _LN_C[bits >> np.uint64(50)] - r * (t - beta) - r
            at = np.flatnonzero(ln_a == np.minimum.reduceat(ln_a, begin)[of])
            # the least sample's shingle and step; of equal ones the largest hash, so that order doesn't matter
            token = W.mix(bits[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
            first = np.flatnonzero(np.concatenate([[True], of[at][1:] != of[at][:-1]]))
            made = W.mix(made * np.uint64(0xA0761D6478BD642F) ^ np.maximum.reduceat(token, first))
        out[doc[begin], band] = made
    return out


def size_class(total: np.ndarray, limit: float) -> np.ndarray:
    """Similar texts have total weights in a ratio of `limit` or more, so their size classes (powers of 1 / limit) differ by one at most."""
    return np.floor(np.log(np.maximum(total, 1e-9)) / (-math.log(limit) * (1 + 1e-6))).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, print (a hash of the text) and text of every row."""
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))


def _sketch(texts: DataFrame, cells: int, n: int, common: float) -> tuple[np.ndarray, int]:
    """Whether a cell's document frequencies add up to more than `common` of the texts, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(cells, dtype=np.int64), 0
        for batch in batches:
            for _, data, edges in W.chunks(batch, "text"):
                doc, keys, _ = counted(*shingles(W.cut(data, edges, lower=True), n))
                total += np.bincount(_cell(keys, cells), minlength=cells)
                seen += len(np.unique(doc))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, cells)), pa.array(np.append(total[used], seen))], ["cell", "times"])

    load = materialize(texts.select("text").mapInArrow(run, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")), "near-sketch")
    seen = load.where(F.col("cell") == cells).agg(F.sum("times")).first()[0] or 0
    # 64 cells are the bits of one row, so the driver gets cells / 64 rows at most
    full = load.where((F.col("cell") < cells) & (F.col("times") > common * seen)).groupBy(F.shiftright("cell", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(-(-cells // 64), dtype="<i8")
    out[full["at"].to_numpy()] = full["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), count=cells, bitorder="little").astype(bool), seen


def fit_weights(texts: DataFrame, n: int, cells: int, damping: float, common: float) -> Weights:
    """Weights from exact document frequencies of the shingles that more than `common` of the texts hold."""
    crowded, seen = _sketch(texts, cells, n, common)
    least = common * seen
    full = texts.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, edges in W.chunks(batch, "text"):
                _, keys, _ = counted(*shingles(W.cut(data, edges, lower=True), n))
                keys, times = np.unique(keys[full.value[_cell(keys, cells)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], ["key", "times"])

    df = texts.select("text").mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") > least).toArrow()
    keys = df["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Weights(keys[order], df["times"].to_numpy().astype(float)[order], seen, damping, common)


def _prints(texts: DataFrame, weights, n: int, bands: int, rows: int, limit: float) -> DataFrame:
    """doc_id, print, a, b (hash of the words), step (size class) and keys (one a band) of each text with words."""
    names = ["doc_id", "print", "a", "b", "step", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text", 500_000):
                words = W.cut(data, edges, lower=True)
                doc, keys, times = counted(*shingles(words, n))
                w = weights.value.of(keys, times)
                step = size_class(np.bincount(doc, weights=w, minlength=part.num_rows), limit)
                made = band_keys(doc, keys, w, part.num_rows, bands, rows).view(np.int64)
                a, b = (words.span_hashes(words.first[:-1], words.first[1:], second=x).view(np.int64) for x in (False, True))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("print"), pa.array(a), pa.array(b), pa.array(step), lists], names).filter(pa.array(words.counts > 0))

    return texts.mapInArrow(run, "doc_id long, print long, a long, b long, step long, keys array<long>")


def similarity(left: W.Words, right: W.Words, weights: Weights, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of the i-th texts of both sides."""
    a, b = (counted(*shingles(x, n)) for x in (left, right))
    doc = np.concatenate([a[0], b[0]])
    keys = np.concatenate([a[1], b[1]])
    w = np.concatenate([weights.of(a[1], a[2]), weights.of(b[1], b[2])]).astype(np.float64)
    order = np.lexsort((keys, doc))
    doc, keys, w = doc[order], keys[order], w[order]
    met = np.flatnonzero((doc[1:] == doc[:-1]) & (keys[1:] == keys[:-1]))
    both = np.bincount(doc[met], weights=np.minimum(w[met], w[met + 1]), minlength=len(left.edges) - 1)
    total = np.bincount(doc, weights=w, minlength=len(left.edges) - 1)
    return both / np.maximum(total - both, 1e-12)


def _verified(pairs: DataFrame, texts: DataFrame, weights, n: int) -> DataFrame:
    """Pairs (a, b) with the exact similarity of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text_a", 500_000):
                for inner, data_b, edges_b in W.chunks(part, "text_b", 500_000):
                    data_a, edges_a = W.texts(inner.column("text_a"))
                    found = similarity(W.cut(data_a, edges_a, lower=True), W.cut(data_b, edges_b, lower=True), weights.value, n)
                    yield pa.RecordBatch.from_arrays([inner.column("a"), inner.column("b"), pa.array(found)], ["a", "b", "similarity"])

    side = lambda of: texts.select(F.col("rep").alias(of), F.col("text").alias(f"text_{of}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long, similarity double")


def _near(table: DataFrame, rows: int) -> DataFrame:
    return table.coalesce(1) if rows <= SMALL else table


def _state(table: DataFrame) -> tuple:
    return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, class (the least node reachable) of every node with a link (a, b).

    Large-star and small-star rounds (Kiveris et al. 2014): neighbours are joined to the
    least one known until nothing changes; the edge table is written after each step.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    state = _state(edges)
    while state[0]:
        edges = _near(edges, state[0])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: a node's larger neighbours point to the least of its neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = _near(materialize(large, "near-large"), state[0])  # no more rows than there were edges
        # small star: a node and its smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "near-small")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(roots.select("node", F.col("node").alias("class")))


def block_similarity(left: W.Words, right: W.Words, weights: Weights, n: int, most: int = 250_000) -> np.ndarray:
    """Weighted Jaccard similarities of all left texts (rows) and all right texts (columns)."""
    rows, cols = len(left.edges) - 1, len(right.edges) - 1
    (doc_a, key_a, tf_a), (doc_b, key_b, tf_b) = (counted(*shingles(x, n)) for x in (left, right))
    w_a, w_b = weights.of(key_a, tf_a), weights.of(key_b, tf_b)
    total = np.bincount(doc_a, weights=w_a, minlength=rows)[:, None] + np.bincount(doc_b, weights=w_b, minlength=cols)[None, :]
    order = np.argsort(key_b, kind="stable")
    key_b, doc_b, w_b = key_b[order], doc_b[order], w_b[order]
    low, high = np.searchsorted(key_b, key_a, "left"), np.searchsorted(key_b, key_a, "right")
    met = np.flatnonzero(high > low)
    both = np.zeros(rows * cols)
    reach = np.cumsum(high[met] - low[met])
    at = 0
    while at < len(met):  # expand a bounded number of meetings at a time
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, "right")))
        part = met[at:to]
        size = high[part] - low[part]
        of = np.repeat(part, size)
        other = np.repeat(low[part], size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        both += np.bincount(doc_a[of] * cols + doc_b[other], weights=np.minimum(w_a[of], w_b[other]), minlength=rows * cols)
        at = to
    both = both.reshape(rows, cols)
    return both / np.maximum(total - both, 1e-12)


def _in_blocks(open_: DataFrame, texts: DataFrame, weights, n: int, limit: float) -> DataFrame:
    """Links (a, b) between members outside a key's largest class and members of other classes of the key.

    A block holds texts of one sort: those that lie outside the largest class of some key
    (minor), or the rest, of which no two of different classes share a key.
    """
    rows = materialize(open_.join(_largest(open_), "key").withColumn("minor", F.col("class") != F.col("main")), "near-rows")
    # blocks are made among texts with one largest key: full blocks of texts that may meet
    members = materialize(rows.groupBy("key").agg(F.count("*").alias("members")), "near-sizes")
    home = F.max(F.struct("members", "key"))["key"].alias("home")
    reps = rows.join(members, "key").groupBy("rep").agg(home, F.max("class").alias("class"), F.max("minor").alias("minor"))
    reps = materialize(reps.join(texts.select("rep", F.octet_length("text").alias("bytes")), "rep"), "near-homes")
    homes = reps.groupBy("home", "minor").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("parts"))
    block = F.xxhash64("home", "minor", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")
    blocks = materialize(reps.join(homes, ["home", "minor"]).select("rep", "class", "minor", block), "near-blocks")
    met = materialize(rows.select("key", "rep").join(blocks.select("rep", "block", "minor"), "rep").select("key", "block", "minor").distinct(), "near-met")
    # keys that join the same blocks count once
    same = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("block")).alias("x"), F.bit_xor(F.xxhash64("block", F.lit(1))).alias("y"))
    met = materialize(met.join(same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key"), "near-met")
    once = ~F.col("other") | (F.col("a") <= F.col("b"))
    tries = met.where("minor").select("key", F.col("block").alias("a")).join(met.select("key", F.col("block").alias("b"), F.col("minor").alias("other")), "key").where(once)
    tries = materialize(tries.select("a", "b").distinct(), "near-tries").repartition(texts.sparkSession.sparkContext.defaultParallelism)
    held = materialize(blocks.select("rep", "class", "block").join(texts, "rep"), "near-held")
    sides = [tries.select("a", "b", F.col(side).alias("block"), F.lit(side).alias("side")) for side in ("a", "b")]
    full = sides[0].unionByName(sides[1]).join(held, "block").select("a", "b", "side", "rep", "class", "text")

    def run(pair: pa.Table) -> pa.Table:
        left, right = (pair.filter(pa.compute.equal(pair["side"], side)) for side in ("a", "b"))
        found = block_similarity(*(W.cut(*W.texts(x["text"]), lower=True) for x in (left, right)), weights.value, n)
        (rep_a, class_a), (rep_b, class_b) = ([x[c].to_numpy() for c in ("rep", "class")] for x in (left, right))
        hit = np.argwhere((found >= limit) & (class_a[:, None] != class_b[None, :]))
        return pa.table({"a": rep_a[hit[:, 0]], "b": rep_b[hit[:, 1]]})

    return materialize(full.groupBy("a", "b").applyInArrow(run, "a long, b long"), "near-block-links")


def _largest(open_: DataFrame) -> DataFrame:
    """key, main: the class with the most members of each key."""
    sizes = open_.groupBy("key", "class").agg(F.count("*").alias("size"))
    return sizes.groupBy("key").agg(F.max(F.struct("size", "class")).alias("main")).select("key", F.col("main.class").alias("main"))


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """rep, class after links (a, b) have joined classes."""
    of = lambda side: known.select(F.col("rep").alias(side), F.col("class").alias(f"c{side}"))
    moved = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    both = known.join(moved.select(F.col("node").alias("class"), F.col("class").alias("now")), "class", "left")
    return materialize(both.select("rep", F.coalesce("now", "class").alias("class")), "near-classes")


def _classed(reps: DataFrame, docs: DataFrame, weights, n: int, limit: float) -> DataFrame:
    """rep, class: verified links join every two texts that share a key and reach the limit.

    reps: rep, doc_id and print of its text, step and keys.
    """
    keys = reps.select("rep", "step", F.explode(F.array_distinct("keys")).alias("band")).select("rep", F.explode(F.array(F.xxhash64("band", "step"), F.xxhash64("band", F.col("step") + 1))).alias("key"))
    keys = materialize(keys, "near-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    pending = materialize(keys.join(shared, "key"), "near-pending")
    known = materialize(pending.select("rep", F.col("rep").alias("class")).distinct(), "near-classes")
    named = known.join(reps.select("rep", F.col("doc_id").alias("of"), F.col("print").alias("of_print")), "rep")
    texts = docs.join(named, (F.col("print") == F.col("of_print")) & F.col("doc_id").eqNullSafe(F.col("of")))
    texts = materialize(texts.groupBy("rep").agg(F.min("text").alias("text")), "near-texts")
    open_, few, tasks = pending.join(known, "rep"), SMALL + 1, docs.sparkSession.sparkContext.defaultParallelism
    for pivots_of_key in (1, 2):
        if pivots_of_key == 1:
            chosen = open_.groupBy("key").agg(F.min("rep").alias("pivot"))
        else:
            outside = open_.join(_largest(open_), "key").where(F.col("class") != F.col("main"))
            chosen = outside.groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(pivots_of_key))).agg(F.min("rep").alias("pivot")).select("key", "pivot")
        of = open_.select("key", F.col("rep").alias("pivot"), F.col("class").alias("pivot_class"))
        pivots = materialize(chosen.join(of, ["key", "pivot"]), "near-pivots")
        tries = open_.join(pivots, "key").where(F.col("class") != F.col("pivot_class"))
        pairs = tries.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        if few <= SMALL:
            pairs = pairs.repartition(tasks)
        found = materialize(_verified(pairs, texts, weights, n).where(F.col("similarity") >= limit).select("a", "b"), "near-verified")
        known = _merged(known, found)
        # a pivot has met all of its key
        placed = open_.select("key", "rep").join(pivots.select("key", F.col("pivot").alias("rep")), ["key", "rep"], "left_anti").join(known, "rep")
        apart = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
        open_ = materialize(placed.join(apart, "key"), "near-open")
        few = open_.count()
        if not few:
            return known
        open_ = _near(open_, few)
    return _merged(known, _in_blocks(open_, texts, weights, n, limit))


def _members(docs: DataFrame, n: int, limit: float, bands: int, rows: int, cells: int, damping: float, common: float) -> DataFrame:
    """doc_id, print and class (a number) of every row whose text has words."""
    texts = _texts(docs)
    weights = docs.sparkSession.sparkContext.broadcast(fit_weights(texts, n, cells, damping, common))
    prints = materialize(_prints(texts, weights, n, bands, rows, limit), "near-prints")
    # equal words make equal keys; the number of a group is written once and so stays the same
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("least")
    groups = prints.groupBy("a", "b").agg(least, F.any_value("step").alias("step"), F.any_value("keys").alias("keys"))
    reps = materialize(groups.select("a", "b", F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.print", "step", "keys"), "near-reps")
    found = _classed(reps, texts, weights, n, limit)
    of_group = materialize(reps.select("a", "b", "rep").join(found, "rep", "left").select("a", "b", F.coalesce("class", "rep").alias("class")), "near-groups")
    return materialize(prints.select("doc_id", "print", "a", "b").join(of_group, ["a", "b"]).select("doc_id", "print", "class"), "near-members")


def classes(docs: DataFrame, n: int = SHINGLE, limit: float = LIMIT, bands: int = BANDS, rows: int = ROWS, cells: int = SKETCH_CELLS, damping: float = DAMPING, common: float = COMMON) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) of every row."""
    members = _members(docs, n, limit, bands, rows, cells, damping, common)
    names = materialize(members.groupBy("class").agg(F.min("doc_id").alias("class_id")), "near-names")
    alone = _texts(docs).where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select("doc_id", F.col("doc_id").alias("class_id"))
    return members.join(names, "class").select("doc_id", "class_id").unionByName(alone)


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, limit: float = LIMIT, bands: int = BANDS, rows: int = ROWS, cells: int = SKETCH_CELLS, damping: float = DAMPING, common: float = COMMON) -> DataFrame:
    """The rows of one document (the least doc_id, a null one last) of each class, columns unchanged."""
    members = _members(docs, n, limit, bands, rows, cells, damping, common)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    first = materialize(members.groupBy("class").agg(F.min(own).alias("first")), "near-firsts")
    gone = members.join(first, "class").where(own != F.col("first")).select(F.col("doc_id").alias("of"), F.col("print").alias("of_print"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["of"]) & (F.xxhash64(docs["text"].cast("string")) == gone["of_print"]), "left_anti")
