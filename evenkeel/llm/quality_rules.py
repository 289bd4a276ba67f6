"""Quality rules: a learned decision list over text statistics.

Sequential covering (IREP/RIPPER style): each rule is a conjunction of thresholds, grown
on two thirds of the rows still uncovered by the condition with the most FOIL gain,
pruned on the other third, and kept only if it is precise there. The list becomes one
ordered Spark CASE expression, so applying it needs no Python.

Defined results. Null text has no words; a document of too few or too repetitive words
fails the base rules. Rows repeat as given. Without usable labels the learned list is
empty and only the base rules decide. Extra columns are ignored by `statistics` and
passed through by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm import words as W

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
#: Most labelled rows that a list is learned from; more are thinned by a hash of doc_id.
MOST_ROWS = 200_000


def _flags(of: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(of)] = True
    return table


_SYMBOL, _UPPER, _DIGIT, _MARK = _flags(SYMBOLS), _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58))), _flags(b"!?")


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of these aren't the first."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, many = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def count(data: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    words = W.cut(data, edges)
    n, doc = len(edges) - 1, words.doc
    inside = ~W.SEPARATORS[data]
    salt = W.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    feeds = np.flatnonzero(data == 10)
    starts = np.union1d(feeds + 1, edges[:-1])
    starts = starts[starts < len(data)]
    # a line goes up to the next line feed or the end of its text
    feeds = np.append(feeds, len(data))
    ends = np.minimum(feeds[np.searchsorted(feeds, starts)], edges[np.searchsorted(edges, starts, "right")])
    total = np.concatenate([[0], np.cumsum(inside)])
    full = total[ends] > total[starts]
    starts, ends = starts[full], ends[full]
    of = np.searchsorted(edges, starts, "right") - 1
    _, again = _repeats(W.spans_hash(W._BYTE_KEYS[data], starts, ends, W._BYTE_BASE) ^ salt[of])
    at = words.windows(3)
    many, _ = _repeats(words.span_hashes(at, at + 3) ^ salt[doc[at]])
    covered = np.zeros(len(words.start), dtype=bool)
    for k in range(3):
        covered[at[many] + k] = True
    _, seen = _repeats(words.hashes ^ salt[doc])
    by = lambda flags, which: np.bincount(which, weights=flags, minlength=n).astype(np.int64)
    return {
        "n_words": words.counts,
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), edges),
        "n_symbols": _sums(_SYMBOL[data], edges),
        "n_dup_lines": by(again, of),
        "n_repeat_words": by(covered, doc),
        "n_lines": by(np.ones(len(of)), of),
        "n_upper": _sums(_UPPER[data], edges),
        "n_digits": _sums(_DIGIT[data], edges),
        "n_marks": _sums(_MARK[data], edges),
        "n_distinct": words.counts - by(seen, doc),
    }


def statistics(docs: DataFrame, keep: list[str], text: str = "text", as_: str = "stats") -> DataFrame:
    """The columns `keep` of every row, and a struct `as_` of its text's COUNTS."""
    source = docs.select(*keep, *([] if text in keep else [text]))
    kind = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])
    out = T.StructType([source.schema[c] for c in keep] + [T.StructField(as_, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, edges in W.chunks(batch, text):
                counts = count(data, edges)
                stats = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], COUNTS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), stats], [*keep, as_])

    return source.mapInArrow(run, out)


def base_failed(stats: str = "stats", least_words: int = 50, most_repeated_pct: int = 50) -> Column:
    words, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < least_words) | (100 * repeated > most_repeated_pct * words)


def ratios(stats: str = "stats") -> dict[str, Column]:
    """Named features of a document, none of which depends on its length alone."""
    c = {k: F.col(f"{stats}.{k}").cast("double") for k in COUNTS}
    words, chars, lines = (F.greatest(c[k], F.lit(1.0)) for k in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols_per_word": c["n_symbols"] / words,
        "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars,
        "marks_per_word": c["n_marks"] / words,
        "mean_word_chars": c["word_chars"] / words,
        "dup_line_share": c["n_dup_lines"] / lines,
        "repeat_share": c["n_repeat_words"] / words,
        "distinct_share": c["n_distinct"] / words,
        "words_per_line": c["n_words"] / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        hit &= x[c.feature] > c.threshold if c.above else x[c.feature] <= c.threshold
    return hit


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int = 64) -> tuple[float, Condition | None]:
    """The threshold with the most FOIL gain over at most `cuts` quantiles of each feature."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Condition | None] = (0.0, None)
    if not p0 or not n0:
        return best
    before = np.log2(p0 / (p0 + n0))
    for name in sorted(x):
        values = x[name]
        # quantiles of the bad and of the good rows, so that a rare class has cuts inside it
        grid = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts + 2)) for v in (values[bad], values[~bad])]))
        grid = (grid[1:] + grid[:-1]) / 2
        order = np.sort(values[bad]), np.sort(values[~bad])
        below_p, below_n = (np.searchsorted(o, grid, "right") for o in order)
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - before)
            if len(gain) and gain.max() > best[0] + 1e-9:
                best = float(gain.max()), Condition(name, above, float(grid[int(gain.argmax())]))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9, least_cover: int = 5, seed: int = 7) -> list[Rule]:
    """Rules that reject, in order. Small arrays only: labelled rows under MOST_ROWS."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    fold = np.random.default_rng(seed).integers(0, 3, len(bad))
    while len(rules) < most_rules and (bad & left).sum() >= least_cover:
        grow, check = left & (fold > 0), left & (fold == 0)
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < most_conditions and (~bad & inside).any():
            _, found = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside])
            if found is None:
                break
            rule = (*rule, found)
            inside = grow & _holds(rule, x)
        worth = []
        for size in range(1, len(rule) + 1):
            hit = check & _holds(rule[:size], x)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append(((p - n) / max(p + n, 1), -size))
        if not worth:
            break
        rule = rule[: -max(worth)[1]]
        hit = left & _holds(rule, x)
        p = int((hit & bad).sum())
        if p < least_cover or p < least_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule], features: dict[str, Column]) -> Column:
    """True (keep) unless a rule of the ordered list rejects."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test &= features[c.feature] > F.lit(c.threshold) if c.above else features[c.feature] <= F.lit(c.threshold)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def training_rows(stats: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, ratios and quality of at most about `most_rows` labelled documents, one row each: of repeated rows the least, of several labels the lowest."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    rows = stats.where(~base_failed()).select("doc_id", F.struct(*(v.alias(k) for k, v in ratios().items())).alias("x")).join(known, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality")).select("doc_id", "x.*", "quality")


def fit(stats: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, **how) -> list[Rule]:
    """Learn from rows (doc_id, stats) with labels (doc_id, quality); base failures teach nothing."""
    table = training_rows(stats, labels, most_rows).orderBy("doc_id").toArrow()
    if not table.num_rows:
        return []
    return learn({k: table[k].to_numpy() for k in ratios()}, table["quality"].to_numpy() == 0, **how)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows with the base statistics, `base_failed` and `kept`."""
    return stats.select(
        "doc_id",
        *(F.col(f"stats.{c}").alias(c) for c in COUNTS[:5]),
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules, ratios())).alias("kept"),
    )


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass the base rules and the learned list, columns unchanged."""
    name = "stats"
    while name in map(str.lower, docs.columns):
        name += "_"
    rules = fit(statistics(docs, ["doc_id"]), labels)
    whole = statistics(docs, docs.columns, as_=name)
    return whole.where(~base_failed(name) & verdict(rules, ratios(name))).select(*docs.columns)
