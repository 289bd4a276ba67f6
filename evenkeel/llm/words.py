"""Vectorised word work on Arrow text columns.

A batch of texts is looked at as one byte buffer. Words are maximal runs of bytes that
are no separator (space, tab, LF, VT, FF, CR); all separators are ASCII, so cutting
UTF-8 at them is exact. A word's 64-bit hash is a polynomial over its bytes modulo
2**64 with a random byte table, taken from prefix sums and then mixed; a window's hash
is a second polynomial over word hashes. Nothing here touches Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1_000_000

_BYTE_KEYS = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE, _WORD_BASE, _WORD_BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1, 0x8CB92BA72F3D8DD7 | 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        step = np.full(max(n, 1), base % 2**64, dtype=np.uint64)
        step[0] = 1
        known = np.multiply.accumulate(step)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for many spans, from one prefix sum."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    found = (total[end] - total[start]) * powers(inverse(base), len(values) + 1)[start]
    return mix(found ^ ((end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


@dataclass
class Words:
    """Words of consecutive texts.

    data: the texts' bytes; edges: byte offsets of the texts (one more than texts);
    start, end: byte offsets of each word; first: index of each text's first word (one
    more than texts); hashes: a hash per word; doc: the text of each word.
    """

    data: np.ndarray
    edges: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int) -> np.ndarray:
        """Indexes of the words that start a window of n words of one text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        return np.flatnonzero(left >= n)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
        return spans_hash(self.hashes, start, end, _WORD_BASE_2 if second else _WORD_BASE)


def spans(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are `inside`, none across the edge of a text."""
    n = len(inside)
    opens, closes = np.empty(n + 1, dtype=bool), np.empty(n + 1, dtype=bool)
    opens[0], opens[n] = n > 0 and inside[0], False
    opens[1:n] = inside[1:] & ~inside[:-1]
    closes[0], closes[n] = False, n > 0 and inside[-1]
    closes[1:n] = inside[:-1] & ~inside[1:]
    joints = edges[1:-1]
    joints = joints[(joints > 0) & (joints < n)]
    opens[joints] = inside[joints]
    closes[joints] = inside[joints - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes)


def cut(data: np.ndarray, edges: np.ndarray, lower: bool = False) -> Words:
    """Find and hash the words of texts data[edges[i]:edges[i + 1]]."""
    if lower:
        data = LOWER[data]
    start, end = spans(~SEPARATORS[data], edges)
    hashes = spans_hash(_BYTE_KEYS[data], start, end, _BYTE_BASE)
    return Words(data, edges, start, end, np.searchsorted(start, edges), hashes)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `most` bytes of text (a longer text stands alone)."""
    if not batch.num_rows:
        return
    data, edges = texts(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[edges[at] : edges[to]], edges[at : to + 1] - edges[at]
        at = to


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's kept words joined by one space: bytes and offsets."""
    n = len(words.data)
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, words.start[keep], 1)
    np.add.at(step, words.end[keep], -1)
    stays = np.cumsum(step[:n]) > 0
    length = np.where(keep, words.end - words.start, 0)
    doc = words.doc
    kept_before = np.cumsum(keep) - keep
    first_kept = np.concatenate([[0], np.cumsum(keep)])[words.first]
    leads = keep & (kept_before > np.repeat(first_kept[:-1], words.counts))  # a space goes before it
    size = np.bincount(doc, weights=length + leads, minlength=len(words.edges) - 1).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(size)])
    at = np.cumsum(length + leads) - length  # where each kept word begins in the output
    out = np.full(int(edges[-1]), 0x20, dtype=np.uint8)
    shift = at[keep] - words.start[keep]
    source = np.flatnonzero(stays)
    out[source + np.repeat(shift, length[keep])] = words.data[source]
    return out, edges


def column(batch: pa.RecordBatch, name: str, empty: int) -> np.ndarray:
    """An integer column as numpy, nulls as `empty`."""
    return batch.column(name).fill_null(empty).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
