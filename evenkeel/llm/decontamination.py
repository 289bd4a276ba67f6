"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

The sets are an item's windows of `window` consecutive words (an item with fewer words is
one window). A document holds a window only if it holds all of its words, so one prefix
token is necessary and enough: the window's rarest word, by document counts over the
whole corpus. The join is document words to prefix tokens; the length bound (the document
has the window's number of words) and the positional bound (the window, laid over the
document so that the prefix tokens meet, stays inside it) cut candidates before the words
themselves are compared, which makes containment exact.

Benchmarks are small, so prefix tokens are broadcast if their measured size is under
`most_broadcast` bytes; beyond it the same join is shuffled and its candidates return to
their documents by key.

Defined results. A-Z are lower-cased; words are runs of a-z, 0-9 and all non-ASCII
characters. Null and empty texts have no words. Rows are keyed by doc_id and text, nulls
included, so repeated rows each get the same result and clashing doc_ids stay apart.
Items with the same item_id count once each. Extra columns are ignored, or kept by
`drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources.tables import materialize

WINDOW = 10
MOST_BROADCAST = 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(cut, "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win (words) of every window of every item, once for each item."""
    words = items.select("item_id", words_of(items["text"]).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda at: F.slice("words", at, F.lit(window)))).alias("win")).distinct()


def _rarity(docs: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """word, df of every benchmark word: the number of documents that hold it."""
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    held = docs.select(F.explode(F.array_distinct(words_of(docs["text"]))).alias("word"))
    counts = held.join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count("*").alias("df"))
    return vocabulary.join(counts, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))


def _prefixes(wins: DataFrame, rarity: DataFrame) -> DataFrame:
    """word, lead, length, win: each distinct window under its rarest word, `lead` words before it."""
    placed = wins.select("win").distinct().select("win", F.posexplode("win").alias("lead", "word")).join(rarity, "word")
    best = placed.groupBy("win").agg(F.min(F.struct("df", "word", "lead")).alias("best"))
    return best.select(F.col("best.word").alias("word"), F.col("best.lead").alias("lead"), F.size("win").alias("length"), "win")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """Places (doc_id, print, at, length, win) of item windows in documents, and the items' windows."""
    wins = materialize(item_windows(items, window), "leak-windows")
    size = wins.select(F.sum(F.expr("aggregate(win, 32L, (n, w) -> n + octet_length(w) + 32L)"))).first()[0] or 0
    small = size <= most_broadcast
    prefixes = materialize(_prefixes(wins, _rarity(docs, wins, small)), "leak-prefixes")
    texts = docs.select("doc_id", F.xxhash64("text").alias("print"), words_of(docs["text"]).alias("words"))
    fits = (F.col("pos") >= F.col("lead")) & (F.col("pos") - F.col("lead") + F.col("length") <= F.col("n"))
    at = (F.col("pos") - F.col("lead")).alias("at")
    if small:
        tokens = texts.select("doc_id", "print", "words", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
        found = tokens.join(F.broadcast(prefixes), "word").where(fits).where(F.slice("words", F.col("pos") - F.col("lead") + 1, F.col("length")) == F.col("win"))
        places = found.select("doc_id", "print", at, "length", "win")
    else:
        tokens = texts.select("doc_id", "print", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
        tried = tokens.join(prefixes, "word").where(fits).select("doc_id", "print", at, "length", F.xxhash64("win").alias("of"))
        mine = tried.groupBy("doc_id", "print").agg(F.collect_set(F.struct("at", "length", "of")).alias("tries"))
        same = F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("t.print").eqNullSafe(F.col("m.print"))
        back = texts.alias("t").join(mine.alias("m"), same).select("t.doc_id", "t.print", "t.words", F.explode("m.tries").alias("try"))
        cut = back.select("doc_id", "print", "try.at", "try.length", F.slice("words", F.col("try.at") + 1, F.col("try.length")).alias("win")).where(F.xxhash64("win") == F.col("try.of"))
        places = cut.join(prefixes.select("win"), "win").select("doc_id", "print", "at", "length", "win")
    return places.distinct(), wins


def inspect(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Every row's doc_id, print, n_words, n_hit, items (ids as sorted strings), contaminated."""
    docs = docs.select("doc_id", "text")
    places, wins = occurrences(docs, items.select("item_id", "text"), window, most_broadcast)
    places = materialize(places, "leak-places")
    spans = F.flatten(F.transform(F.collect_list(F.struct("at", "length")), lambda p: F.sequence(p["at"], p["at"] + p["length"] - 1)))
    hits = places.groupBy("doc_id", "print").agg(F.size(F.array_distinct(spans)).cast("long").alias("n_hit"))
    held = places.select("doc_id", "print", "win").distinct().join(wins, "win").where("item_id is not null")
    named = held.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = hits.join(named, hits["doc_id"].eqNullSafe(named["doc_id"]) & hits["print"].eqNullSafe(named["print"]), "left").select(hits["doc_id"].alias("of"), hits["print"].alias("of_print"), "n_hit", "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("print"), F.size(words_of(docs["text"])).cast("long").alias("n_words"))
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("print").eqNullSafe(F.col("of_print")), "left")
    return out.select("doc_id", "print", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def sql(window: int = WINDOW) -> str:
    """DuckDB form of the query over `inspect`, for tables whose doc_id names a row."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[k:k + {window} - 1], ' ') AS win, least(len(w), {window}) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM i) ON n <= len(w)),
o AS (SELECT DISTINCT s.doc_id, s.k, s.n, i.item_id FROM s JOIN i ON i.n = s.n AND i.win = array_to_string(s.w[s.k:s.k + s.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows that hold no window of any item, columns unchanged."""
    places, _ = occurrences(docs.select("doc_id", "text"), items.select("item_id", "text"), window, most_broadcast)
    bad = places.select(F.col("doc_id").alias("of"), F.col("print").alias("of_print")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["of"]) & (F.xxhash64(docs["text"]) == bad["of_print"]), "left_anti")
