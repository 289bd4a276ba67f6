"""Toxicity by weak supervision.

1. Voters. Words and word beginnings (4 to 7 bytes) are hashed to cells; counted over the
   labelled training rows, the cells that lean most to toxic texts become a mined lexicon,
   each entry a voter. Pattern voters look at how many entries a text hits, how densely,
   and at a small general lexicon of insults. A voter says toxic, clean, or nothing.
2. Label model, on votes alone: over a sample of all training documents, labelled or not,
   voters have accuracies and correlations given the unknown true label. Expectation
   maximisation estimates both and discounts voters that repeat each other; its posterior
   is a soft label. Given labels choose lexicon entries and the first class prior; no row's
   own label takes part in its posterior.
3. A linear classifier over the selected cells is trained on the posteriors and scores
   every text; scores use the text alone.

Training rows lie outside the held-out part (crc32 of the id as text modulo 4 is 2). The
sample has about `most_rows` rows, thinned by a hash of a row's place, so that copies of a row
don't add to it; lexicon counts cover all labelled training rows. At most a million labels
are broadcast.

Defined results. Null and empty texts get the score of a text without any feature. Rows
repeat as given; a null doc_id is not held out. Labels that are null or of unknown rows
are ignored; without both labels in the training rows every score is the prior. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import words as W

CELLS = 1 << 19
MOST_ROWS = 50_000
MOST_BROADCAST = 1_000_000
MOST_FEATURES = 3_000
MOST_VOTERS = 64
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
#: Log-odds of one vote before accuracies are known.
START = 1.5
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "ugly")

_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b"\"'()[]{}.,;:!?*_-")] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, edges: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and cell of every feature of every word, and the number of words of each text."""
    words = W.cut(data, edges, lower=True)
    start, end, doc = words.start.copy(), words.end.copy(), words.doc
    for _ in range(3):  # up to three marks around a word are no part of it
        start += (end - start > 1) & _EDGE[words.data[start]]
        end -= (end - start > 1) & _EDGE[words.data[end - 1]]
    keys = W._BYTE_KEYS[words.data]
    docs, found = [doc], [W.spans_hash(keys, start, end, W._BYTE_BASE)]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        docs.append(doc[long])
        found.append(W.spans_hash(keys, start[long], start[long] + n, W._BYTE_BASE) ^ np.uint64(n))
    cell = (W.mix(np.concatenate(found)) >> np.uint64(8)) % np.uint64(cells)
    return np.concatenate(docs), cell.astype(np.int64), words.counts


def seed_cells(cells: int = CELLS) -> np.ndarray:
    data, edges = W.texts(pa.array(SEEDS))
    doc, cell, _ = features(data, edges, cells)
    return np.unique(cell[: len(SEEDS)])


def _pairs(doc: np.ndarray, item: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, item)."""
    both = np.unique(doc * most + item)
    return both // most, both % most


def labelled_rows(docs: DataFrame, labels: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """text and toxic of the labelled training rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("toxic").cast("int").alias("toxic")).where("of is not null and toxic is not null")
    known = known.where(~held_out(F.col("of"))).groupBy("of").agg(F.max("toxic").alias("toxic"))
    side = F.broadcast(known) if known.count() <= most_broadcast else known
    return docs.select("doc_id", "text").join(side, F.col("doc_id").cast("long") == F.col("of")).select(F.col("text").cast("string").alias("text"), "toxic")


def sample_rows(docs: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """text of about `most_rows` training rows, labelled or not."""
    share = min(1.0, most_rows / max(docs.count(), 1))
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("of"), F.xxhash64(F.monotonically_increasing_id()).alias("place"))
    return rows.where(~held_out(F.col("of")) & (F.pmod("place", F.lit(1_000_000)) < int(1_000_000 * share))).select("text")


def _counts(rows: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Toxic and clean texts by cell, and altogether."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells + 1), dtype=np.int64)
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text"):
                toxic = W.column(part, "toxic", 0) > 0
                doc, cell = _pairs(*features(data, edges, cells)[:2], cells)
                for k, which in enumerate((toxic, ~toxic)):
                    total[k, :cells] += np.bincount(cell[which[doc]], minlength=cells)
                    total[k, cells] += which.sum()
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], ["cell", "toxic", "clean"])

    sums = rows.mapInArrow(run, "cell long, toxic long, clean long").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a lexicon entry needs toxic texts, so that only such cells (at most `cells`) and the totals come to the driver
    table = sums.where((F.col("toxic") >= 3) | (F.col("cell") == cells)).toPandas()
    out = np.zeros((2, cells + 1), dtype=np.int64)
    out[0, table["cell"]], out[1, table["cell"]] = table["toxic"], table["clean"]
    return out[0, :cells], out[1, :cells], int(out[0, cells]), int(out[1, cells])


def select(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, most: int = MOST_FEATURES, least_lift: float = 4.0) -> np.ndarray:
    """Cells that lean to toxic texts, strongest first (by the log-likelihood ratio).

    Their lift is at least that given, and the root of the lift of the ten strongest: where
    labels tell entries apart well, weak ones only blur the votes; where labels are noisy, all lifts are low.
    """
    if not n_toxic or not n_clean:
        return np.empty(0, dtype=np.int64)
    rate_t, rate_c = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    both = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    worth = 2 * (toxic * np.log(rate_t / both) + clean * np.log(rate_c / both))
    good = np.flatnonzero((toxic >= 3) & (rate_t > least_lift * rate_c) & (worth > 15))
    good = good[np.argsort(-worth[good], kind="stable")]
    if len(good):
        lift = rate_t[good] / rate_c[good]
        good = good[lift > np.sqrt(np.median(lift[:10]))]
    return good[:most]


def _hits(rows: DataFrame, chosen: np.ndarray, cells: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Chosen features and number of words of each sampled row."""
    place = np.full(cells, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text"):
                doc, item, count = _chosen(data, edges, shared.value, cells)
                cuts = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(item, pa.int32())), pa.array(count)], ["items", "n_words"])

    table = rows.mapInArrow(run, "items array<int>, n_words long").toPandas()  # about most_rows short rows
    return [np.asarray(x, dtype=np.int64) for x in table["items"]], table["n_words"].to_numpy()


def _chosen(data: np.ndarray, edges: np.ndarray, place: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, cell, count = features(data, edges, cells)
    item = place[cell]
    some = item >= 0
    doc, item = _pairs(doc[some], item[some], len(place) + 1)
    return doc, item, count


def votes(items: list[np.ndarray], n_words: np.ndarray, n_lexicon: int, seeds: np.ndarray) -> np.ndarray:
    """Rows x voters: 1 toxic, -1 clean, 0 nothing."""
    out = np.zeros((len(items), n_lexicon + 4), dtype=np.int8)
    for i, mine in enumerate(items):
        out[i, mine[mine < n_lexicon]] = 1
    hits = np.array([len(x) for x in items])
    dense = hits / np.maximum(n_words, 1)
    out[:, n_lexicon] = np.where(hits >= 3, 1, np.where(hits == 0, -1, 0))
    out[:, n_lexicon + 1] = np.where(hits >= 8, 1, 0)
    out[:, n_lexicon + 2] = np.where(dense >= 0.02, 1, np.where(dense == 0, -1, 0))
    out[:, n_lexicon + 3] = [int(np.isin(x, seeds).any()) for x in items]
    return out


def label_model(vote: np.ndarray, prior: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, each voter's accuracy, and the voters' correlations, from votes alone.

    Expectation maximisation of a latent-label model, begun with voters of equal accuracy. Each
    voter has a distribution of its three votes for either label; correlated voters share
    their weight (at first those whose votes are alike, then those alike within a label).
    """

    def shared(centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cov = centred.T @ centred / max(len(centred), 1)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = np.clip(cov / np.outer(scale, scale), -1, 1)
        return correlation, 1 / np.maximum(np.sum(correlation**2, axis=1), 1)

    said = np.stack([vote == v for v in (-1, 0, 1)]).astype(float)  # 3 x rows x voters
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    x = (vote == 1).astype(float)
    correlation, discount = shared(vote - vote.mean(axis=0))
    posterior = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + START * vote @ discount, -30, 30)))
    accuracy = np.full(vote.shape[1], 0.5)
    for _ in range(rounds):
        chance = [(np.einsum("vrj,r->vj", said, q) + 0.1) / (q.sum() + 0.3) for q in (1 - posterior, posterior)]
        correlation, discount = shared(x - np.outer(1 - posterior, chance[0][2]) - np.outer(posterior, chance[1][2]))
        accuracy = (chance[1][2] * prior + chance[0][0] * (1 - prior)) / np.maximum((chance[1][2] + chance[1][0]) * prior + (chance[0][2] + chance[0][0]) * (1 - prior), 1e-9)
        odds = np.log(prior / (1 - prior)) + np.einsum("vrj,vj->r", said, np.log(chance[1] / chance[0]) * discount)
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = float(np.clip(posterior.mean(), 1e-3, 1 - 1e-3))
        if np.abs(before - posterior).max() < 1e-4:
            break
    return posterior, accuracy, correlation


def train(items: list[np.ndarray], target: np.ndarray, n_features: int, rounds: int = 400, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (full-batch Adam over sparse rows)."""
    row = np.repeat(np.arange(len(items)), [len(x) for x in items])
    col = np.concatenate(items) if len(row) else row
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=len(items)) + w[-1]
        miss = (1 / (1 + np.exp(-z)) - target) / len(items)
        g = np.append(np.bincount(col, weights=miss[row], minlength=n_features), miss.sum())
        g[:-1] += ridge * w[:-1] / len(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    place: np.ndarray
    weights: np.ndarray
    bias: float
    accuracy: np.ndarray
    correlation: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, cells: int = CELLS) -> Model:
    toxic, clean, n_toxic, n_clean = _counts(labelled_rows(docs, labels), cells)
    chosen = select(toxic, clean, n_toxic, n_clean)
    place = np.full(cells, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    prior = (n_toxic + 1) / (n_toxic + n_clean + 2)
    if not len(chosen):
        return Model(place, np.zeros(0), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, 0)))
    items, n_words = _hits(sample_rows(docs, most_rows), chosen, cells)
    seeds = place[seed_cells(cells)]
    vote = votes(items, n_words, min(MOST_VOTERS, len(chosen)), seeds[seeds >= 0])
    posterior, accuracy, correlation = label_model(vote, prior)
    weights, bias = train(items, posterior, len(chosen))
    return Model(place, weights, bias, accuracy, correlation)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text"):
                doc, item, _ = _chosen(data, edges, model.place, len(model.place))
                z = np.bincount(doc, weights=model.weights[item], minlength=part.num_rows) + model.bias
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    found = texts.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
