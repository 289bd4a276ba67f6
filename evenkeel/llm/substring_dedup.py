"""Substring dedup by compacting a de Bruijn graph of token windows.

Edges of the graph are windows of `window` consecutive words. As in published graph
compactors, the edges are dealt out by their minimizer (the least-hashed `minimizer`
words inside): consecutive edges that share one form a nonbranching path piece, a few
times fewer rows than edges. The rest is Spark joins:

1. pieces whose minimizer occurs once in the corpus are unrepeated and go;
2. equal pieces meet in one class, whose first source coordinate stands for it; every
   other occurrence is a repeat of that source as a whole;
3. a minimizer with one class of pieces is a place where no path branches. Where it has
   several, the first piece of each class is opened into its edges, and each edge is
   compared with its own first coordinate;
4. repeats return to their documents by source coordinate; those that adjoin, and whose
   sources adjoin alike, compact into long spans (`long_spans`), and these are removed.

Equality means equal 64-bit hashes of both the minimizer and the piece or edge it lies
in, 128 bits together. No row holds more than one document's pieces; no group is
gathered except the pieces of one document.

Defined results. Null or empty text has no words and nothing removed. doc_id orders
documents; a null doc_id comes last. Rows that share a doc_id (or have none) but not the
text are documents of their own, in the order of a hash of the text; rows that share both
are one document: their equal coordinates are not earlier than each other. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.llm import words as W
from evenkeel.sources.tables import materialize

WINDOW, MINIMIZER = 20, 5
LAST = 2**63 - 1


def _id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))


def _texts(docs: DataFrame) -> DataFrame:
    """id, print (a hash of the text) and text of every row; id and print name a document."""
    text = docs["text"].cast("string")
    return docs.select(_id(docs).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in values[i:i + width], for each i."""
    where = np.arange(len(values))
    have = 1
    while have < width and len(values):
        step = min(have, width - have)
        left = values[:-step] <= values[step:]
        values = np.where(left, values[:-step], values[step:])
        where = np.where(left, where[:-step], where[step:])
        have += step
    return where


def path_pieces(words: W.Words, window: int, minimizer: int) -> tuple[np.ndarray, ...]:
    """Text, first word, edges, minimizer hash and piece hash of each nonbranching piece."""
    edge = words.windows(window)
    none = np.empty(0, dtype=np.int64)
    if not len(edge):
        return none, none, none, none, none
    order = np.full(len(words.start), 2**64 - 1, dtype=np.uint64)
    at = words.windows(minimizer)
    order[at] = words.span_hashes(at, at + minimizer)
    chosen = least(order, window - minimizer + 1)[edge]
    fresh = np.ones(len(edge), dtype=bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (edge[1:] != edge[:-1] + 1)
    lead = np.flatnonzero(fresh)
    first, n = edge[lead], np.diff(np.append(lead, len(edge)))
    doc = np.searchsorted(words.first, first, "right") - 1
    body = words.span_hashes(first, first + n + window - 1, second=True)
    return doc, first - words.first[doc], n, order[chosen[lead]].view(np.int64), body.view(np.int64)


def pieces(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """id, print, at, n (edges), key (minimizer), body of every path piece of every document."""
    names = ["id", "print", "at", "n", "key", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text"):
                doc, at, n, key, body = path_pieces(W.cut(data, edges), window, minimizer)
                ids, prints = W.column(part, "id", LAST)[doc], W.column(part, "print", 0)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(prints), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(key), pa.array(body)], names)

    return _texts(docs).mapInArrow(run, "id long, print long, at int, n int, key long, body long")


def _edges(texts: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """id, print, at, key, edge of every edge of the opened pieces (id, print, at, n, key)."""
    names = ["id", "print", "at", "key", "edge"]
    mine = opened.groupBy("id", "print").agg(F.collect_list(F.struct("at", "n", "key")).alias("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text"):
                words, opens = W.cut(data, edges), part.column("open")
                size = pa.compute.list_value_length(opens).to_numpy(zero_copy_only=False)
                flat = opens.flatten()
                at, n, key = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                doc = np.repeat(np.arange(part.num_rows), size)
                of = np.repeat(np.arange(len(at)), n)
                local = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = words.first[doc[of]] + local
                fits = local + window <= words.counts[doc[of]]  # a clash of prints may point past a text's end
                of, local, start = of[fits], local[fits], start[fits]
                edge = words.span_hashes(start, start + window, second=True).view(np.int64)
                ids, prints = W.column(part, "id", LAST)[doc[of]], W.column(part, "print", 0)[doc[of]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(prints), pa.array(local, pa.int32()), pa.array(key[of]), pa.array(edge)], names)

    return texts.join(mine, ["id", "print"]).select("id", "print", "text", "open").mapInArrow(run, "id long, print long, at int, key long, edge long")


def _later(first: str) -> Column:
    """The row's own coordinate comes after `first`."""
    return F.struct("id", "print", "at") > F.col(first)


def repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """id, print, at, length, source_id, source_print, source_at: words that repeat an earlier source, window-wise.

    Pieces may overlap; together they cover exactly the words to remove.
    """
    every = pieces(docs, window, minimizer)
    # sums are written before they meet rows again: a join of two plain shuffles splits a hot key
    shared = every.groupBy("key").agg(F.count("*").alias("times"), F.min("body").alias("low"), F.max("body").alias("high")).where("times > 1")
    shared = materialize(shared.select("key", (F.col("low") != F.col("high")).alias("branches")), "op2-shared")
    again = materialize(every.join(shared, "key").select("id", "print", "at", "n", "key", "body", "branches"), "op2-pieces")
    place = F.min(F.struct("id", "print", "at")).alias("first")
    classes = again.groupBy("key", "body").agg(F.first("n").alias("edges"), F.first("branches").alias("opens"), F.count("*").alias("copies"), place)
    classes = materialize(classes.where("copies > 1 or opens"), "op2-classes")
    copies = again.join(classes.where("copies > 1").select("key", "body", "first"), ["key", "body"]).where(_later("first"))
    source = [F.col(f"first.{c}").alias(f"source_{c}") for c in ("id", "print", "at")]
    whole = copies.select("id", "print", "at", (F.col("n") + window - 1).alias("length"), *source)
    opened = classes.where("opens").select("first.id", "first.print", "first.at", F.col("edges").alias("n"), "key")
    edges = _edges(_texts(docs), opened, window)
    firsts = edges.groupBy("key", "edge").agg(F.count("*").alias("times"), place).where("times > 1")
    later = edges.join(firsts, ["key", "edge"]).where(_later("first"))
    return whole.unionByName(later.select("id", "print", "at", F.lit(window).alias("length"), *source))


def long_spans(found: DataFrame) -> DataFrame:
    """id, print, source_id, source_print, at, length, source_at of maximal repeated spans.

    Repeats of one document that adjoin, and whose sources adjoin alike, are one span of that
    source; the coordinates of both verify it. Repeated rows leave equal repeats only, which go
    before the shuffle; the rest stays in the document's own partition.
    """
    shift = (F.col("source_at") - F.col("at")).alias("shift")
    gathered = found.groupBy("id", "print").agg(F.collect_set(F.struct("source_id", "source_print", shift, "at", "length")).alias("all"))
    each = gathered.select("id", "print", F.explode("all").alias("one")).select("id", "print", "one.*")
    line = ["id", "print", "source_id", "source_print", "shift"]
    mine = Window.partitionBy(*line).orderBy("at")
    reach = F.max(F.col("at") + F.col("length")).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("path", F.sum(F.when(F.col("at") <= reach, 0).otherwise(1)).over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy(*line, "path").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("length")).alias("end"))
    return spans.select("id", "print", "source_id", "source_print", "at", (F.col("end") - F.col("at")).alias("length"), (F.col("at") + F.col("shift")).alias("source_at"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (kept_text)."""
    mine = long_spans(repeats(docs, window, minimizer)).groupBy("id", "print").agg(F.collect_list(F.struct("at", "length")).alias("spans"))
    mine = mine.select("id", "print", F.col("spans.at").alias("at"), F.col("spans.length").alias("length"))
    texts = _texts(docs)
    names = ["id", "n_words", "n_removed", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, edges in W.chunks(batch, "text"):
                words = W.cut(data, edges)
                size = pa.compute.list_value_length(part.column("at")).fill_null(0).to_numpy(zero_copy_only=False)
                at, length = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "length"))
                doc = np.repeat(np.arange(part.num_rows), size)
                begin = np.minimum(words.first[doc] + at, words.first[doc + 1])
                end = np.minimum(begin + length, words.first[doc + 1])
                step = np.zeros(len(words.start) + 1, dtype=np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, end, -1)
                keep = np.cumsum(step[:-1]) == 0
                out, cuts = W.joined(words, keep)
                kept = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
                gone = words.counts - np.bincount(words.doc, weights=keep, minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(W.column(part, "id", LAST)), pa.array(words.counts, pa.int64()), pa.array(gone, pa.int64()), kept], names)

    found = texts.join(mine, ["id", "print"], "left").select("id", "text", "at", "length").mapInArrow(run, "id long, n_words long, n_removed long, kept_text string")
    return found.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_text")


def sql(window: int = WINDOW) -> str:
    """DuckDB form of the query over `remove_repeats`, for tables whose doc_id names a row: every window is compared as text."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(w[k:k + {window} - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - {window} + 2)) AS k FROM d)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, k) AS nr FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + {window})) AS at FROM r WHERE nr > 1),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS at FROM d),
k AS (SELECT u.doc_id, string_agg(u.w[u.at], ' ' ORDER BY u.at) AS kept, count(*) AS n FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.at = u.at WHERE g.at IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
