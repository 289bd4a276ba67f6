"""Seeded resampling, reproducible to the bit.

The generator is a counter: the k-th draw of a seed is a fixed mix of seed + k * step
modulo 2**64. So every iteration knows where its draws begin, and iterations of one
measurement are dealt out over tasks in blocks.

The null floor carries its pool from one iteration to the next. A measurement goes through its
iterations in one task, unless there are more tasks than measurements. Then it is cut into
blocks: what an iteration does to the pool's places doesn't depend on what lies there, so each
block is first reduced to one permutation of places, the permutations of a measurement are
composed in order, and each block then counts from the pool that it really starts with. As
that goes through the draws twice, blocks are as many as bring the end nearest.

One stream serves a measurement: the bootstrap first, the null floor after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.sources.tables import materialize

ITERATIONS = 10_000
BLOCK, MOST_DRAWS = 500, 2**15  # iterations of a block, and draws held at once: as many as a core's cache holds
MOST_BLOCKS, LARGE = 20, 20_000  # blocks of one null floor, and places of a pool from which swaps are made many at a time
MOST_CALLS, LOCKSTEP = 2_000_000, 128  # calls of a piece of shuffles, and shuffles of one length from which they are made together
# The generator's step and its two multipliers.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def draws(seed: int, start: int, n: int) -> np.ndarray:
    """The draws number start + 1 to start + n of a seed."""
    z = np.arange(start + 1, start + n + 1, dtype=np.uint64)
    z *= np.uint64(STEP)
    z += np.uint64(seed % 2**64)
    return _mixed(z)


def _mixed(z: np.ndarray) -> np.ndarray:
    """The draws of these states, in their place."""
    high = z >> np.uint64(30)
    z ^= high
    z *= np.uint64(FIRST)
    z ^= np.right_shift(z, np.uint64(27), out=high)
    z *= np.uint64(SECOND)
    z ^= np.right_shift(z, np.uint64(31), out=high)
    return z


def _apart(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """Numerators of the distances between rows of counts."""
    return np.abs(x * ny - y * nx).sum(axis=1)


def _redrawn(made: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts by option of each row of draws with replacement."""
    n = np.uint64(counts.sum())
    reply = made // n  # the remainder by way of the quotient: a division by one number is a multiplication
    reply *= n
    np.subtract(made, reply, out=reply)
    up_to = lambda end: [np.count_nonzero(row < np.uint64(end)) for row in reply]
    ends = np.array([np.zeros(len(made), np.int64), *(up_to(end) for end in np.cumsum(counts)[:-1]), np.full(len(made), made.shape[1])], dtype=np.int64)
    return np.diff(ends, axis=0).T


def _redrawn_in_pieces(counts: np.ndarray, seed: int, start: int, most: int) -> np.ndarray:
    """Counts by option of one row of draws, made `most` at a time."""
    n = int(counts.sum())
    return sum(_redrawn(draws(seed, start + at, min(most, n - at))[None, :], counts) for at in range(0, n, most))


def bootstrap_block(cx: np.ndarray, cy: np.ndarray, seed: int, first: int, iterations: int, most: int = MOST_DRAWS) -> np.ndarray:
    """Numerators (over 2 * nx * ny) of the iterations first .. first + iterations - 1, holding at most `most` draws."""
    nx, ny = int(cx.sum()), int(cy.sum())
    if nx + ny > most:
        starts = range(first * (nx + ny), (first + iterations) * (nx + ny), nx + ny)
        return np.concatenate([_apart(_redrawn_in_pieces(cx, seed, at, most), _redrawn_in_pieces(cy, seed, at + nx, most), nx, ny) for at in starts])
    per = max(1, most // (nx + ny))
    out = []
    for at in range(first, first + iterations, per):
        n = min(per, first + iterations - at)
        made = draws(seed, at * (nx + ny), n * (nx + ny)).reshape(n, nx + ny)
        out.append(_apart(_redrawn(made[:, :nx], cx), _redrawn(made[:, nx:], cy), nx, ny))
    return np.concatenate(out)


def _splits(pool: list[int], nx: int, seed: int, start: int, iterations: int) -> Iterator[list[int]]:
    """The pool after each iteration, which draws nx of its places without return from the pool as the one before left it; draws begin after `start` earlier ones."""
    room = np.arange(len(pool), len(pool) - nx, -1, dtype=np.uint64)
    per = max(1, 200_000 // max(nx, 1))
    for begin in range(0, iterations, per):
        n = min(per, iterations - begin)
        jumps = (draws(seed, start + begin * nx, n * nx).reshape(n, nx) % room).astype(np.int64) + np.arange(nx)
        for row in jumps.tolist():
            for i, j in enumerate(row):
                pool[i], pool[j] = pool[j], pool[i]
            yield pool


def _settle(head: np.ndarray, got: np.ndarray, to: np.ndarray, begin: int, at: np.ndarray) -> None:
    """Sets right what the swaps number `at`, in this order, find in their own place and in the place that they draw."""
    own, drawn, now = head[at].tolist(), got[at].tolist(), {}
    for k, (i, j) in enumerate(zip((at + begin).tolist(), to[at].tolist())):
        own[k] = now.get(i, own[k])
        if i == j:
            drawn[k] = own[k]
        else:
            drawn[k], now[j] = now.get(j, drawn[k]), own[k]
    head[at], got[at] = own, drawn


def _large_splits(pool: np.ndarray, nx: int, seed: int, start: int, iterations: int) -> Iterator[np.ndarray]:
    """`_splits` of a large pool, some hundreds of swaps at a time.

    Swaps of neighbouring places that draw different places beyond them don't touch each other.
    Those that draw a place among them or one that another draws are few, and are followed one by one.
    """
    size = len(pool)
    kind = np.int32 if size < 2**31 else np.int64
    room, places, swaps = np.arange(size, size - nx, -1, dtype=np.uint64), np.arange(nx), np.arange(nx, dtype=kind)
    some = math.isqrt(39 * size)  # here what a call of numpy costs is about what the few cost
    per = max(1, MOST_DRAWS // some) * some
    drawn_by = np.empty(size, dtype=kind)
    for before in range(start, start + iterations * nx, nx):
        for low in range(0, nx, per):
            high = min(low + per, nx)
            jumps = draws(seed, before + low, high - low)
            jumps %= room[low:high]
            jumps = jumps.view(np.int64)
            jumps += places[low:high]
            for begin in range(low, high, some):
                end = min(begin + some, high)
                to, own = jumps[begin - low : end - low], swaps[begin:end]
                drawn_by[to] = own  # of several that draw a place, the last stays
                last = drawn_by[to]
                again, among = np.flatnonzero(last != own), np.flatnonzero(to < end)
                head, got = pool[begin:end].copy(), pool[to]
                if len(again) or len(among):
                    _settle(head, got, to, begin, np.unique(np.concatenate([again, last[again] - begin, among, to[among] - begin])))
                pool[to] = head
                pool[begin:end] = got
        yield pool


def block_permutation(size: int, nx: int, seed: int, start: int, iterations: int) -> np.ndarray:
    """From which place the content of each place comes, after some iterations."""
    pool = np.arange(size, dtype=np.int32)
    if size < LARGE:
        for pool in _splits(pool.tolist(), nx, seed, start, iterations):
            pass
        return np.asarray(pool, dtype=np.int32)
    for pool in _large_splits(pool, nx, seed, start, iterations):
        pass
    return pool


def replies(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """The pool before the first iteration: the option of each reply."""
    return np.repeat(np.arange(len(cx)), cx + cy)


def null_floor_sum(cx: np.ndarray, cy: np.ndarray, seed: int, iterations: int, start: int = 0, pool: np.ndarray | None = None) -> int:
    """Sum of the numerators (over 2 * nx * ny) of random splits of the pooled replies, from a pool in a given order."""
    nx, ny = int(cx.sum()), int(cy.sum())
    both = [int(a + b) for a, b in zip(cx, cy)]
    first = replies(cx, cy) if pool is None else pool
    if large := nx + ny >= LARGE:
        after = _large_splits(first.astype(np.min_scalar_type(len(both))), nx, seed, start, iterations)
    else:
        after = _splits(first.tolist(), nx, seed, start, iterations)
    total = 0
    for now in after:
        head = now[:nx]
        for k, of in enumerate(both):
            drawn = int(np.count_nonzero(head == k)) if large else head.count(k)
            total += abs(drawn * ny - (of - drawn) * nx)
    return total


def _some(runs: DataFrame) -> DataFrame:
    """The runs with replies on both sides, written: a row each, which several plans read."""
    n = lambda side: F.coalesce(F.aggregate(side, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    return materialize(runs.where((n("cx") > 0) & (n("cy") > 0)).select("run_id", "cx", "cy", "seed"), "resampled-runs")


def _blocks(runs: DataFrame, iterations: int, block: int) -> DataFrame:
    """A row for each block of iterations of each run."""
    return runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(block))).alias("first"))


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks over all tasks, by ranges, in which few rows lie one by one: a given number keeps adaptive execution from joining these few, costly rows into one task."""
    return blocks.repartitionByRange(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run_id", "first")


def _block(runs: int, tasks: int, iterations: int) -> int:
    """Iterations of a block of the null floor, so that the last task ends soonest: all blocks are counted, and those that another follows are gone through before."""
    turns = lambda n: (math.ceil(runs * n / tasks) + math.ceil(runs * (n - 1) / tasks)) / n
    return math.ceil(iterations / min(range(1, MOST_BLOCKS + 1), key=lambda n: (turns(n), n)))


def bootstrap(runs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """run_id, low_num, high_num, den: the 2.5th and 97.5th nearest-rank gap of resampled replies.

    runs: run_id, cx, cy (counts by option), seed (decimal text); a side without replies has no interval.
    """
    blocks = _blocks(_some(runs), iterations, BLOCK)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                nums = bootstrap_block(np.asarray(r.cx), np.asarray(r.cy), int(r.seed), r.first, min(BLOCK, iterations - r.first))
                yield pd.DataFrame({"run_id": r.run_id, "num": nums, "den": 2 * int(sum(r.cx)) * int(sum(r.cy))})

    nums = _dealt(blocks).mapInPandas(run, "run_id string, num long, den long")
    rank = lambda p, name: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY num)").cast("long").alias(name)
    return nums.groupBy("run_id").agg(rank(0.025, "low_num"), rank(0.975, "high_num"), F.first("den").alias("den"))


def null_floor(runs: DataFrame, iterations: int = ITERATIONS, after_bootstrap: int = 0, block: int | None = None) -> DataFrame:
    """run_id, floor_num, floor_den; the stream goes on after `after_bootstrap` bootstrap iterations. Without a number of iterations for a block it is chosen by runs and cores."""
    some = _some(runs)
    if block is None:
        block = _block(some.count(), some.sparkSession.sparkContext.defaultParallelism, iterations)

    def begun(r) -> tuple[np.ndarray, np.ndarray, int, int]:
        cx, cy = np.asarray(r.cx), np.asarray(r.cy)
        nx, ny = int(cx.sum()), int(cy.sum())
        return cx, cy, after_bootstrap * (nx + ny) + int(r.first) * nx, min(block, iterations - int(r.first))

    def permute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                cx, cy, start, n = begun(r)
                made = block_permutation(int(cx.sum() + cy.sum()), int(cx.sum()), int(r.seed), start, n)
                yield pd.DataFrame({"run_id": [r.run_id], "first": [r.first], "places": [made]})

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first")
        at = [np.asarray(part["places"].iloc[0])]
        for places in part["places"].iloc[1:]:
            at.append(at[-1][places])
        return pd.DataFrame({"run_id": part["run_id"], "first": part["first"] + block, "places": at})

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                cx, cy, start, n = begun(r)
                pool = replies(cx, cy) if r.places is None else replies(cx, cy)[r.places]
                num = null_floor_sum(cx, cy, int(r.seed), n, start, pool)
                yield pd.DataFrame({"run_id": [r.run_id], "num": [num]})

    shape = "run_id string, first int, places array<int>"
    blocks = _blocks(some, iterations, block)
    if block < iterations:
        moved = materialize(_dealt(blocks.where(F.col("first") + block < iterations)).mapInPandas(permute, shape), "floor-blocks")
        starts = materialize(moved.groupBy("run_id").applyInPandas(compose, shape), "floor-starts")  # as many short arrays as a run has blocks
        blocks = blocks.join(starts, ["run_id", "first"], "left")
    else:
        blocks = blocks.withColumn("places", F.lit(None).cast("array<int>"))
    nums = _dealt(blocks).mapInPandas(count, "run_id string, num long")
    den = F.aggregate("cx", F.lit(0).cast("long"), lambda a, x: a + x) * F.aggregate("cy", F.lit(0).cast("long"), lambda a, x: a + x) * 2 * iterations
    sums = nums.groupBy("run_id").agg(F.sum("num").alias("floor_num"))
    return runs.select("run_id", den.alias("den")).join(sums, "run_id", "left").select("run_id", "floor_num", F.when(F.col("floor_num").isNotNull(), F.col("den")).alias("floor_den"))


def call_order(seed: int, n: int) -> list[int]:
    """A seeded shuffle of 0 .. n - 1: from the last place down, swap with a drawn place."""
    order = list(range(n))
    places = np.arange(n - 1, 0, -1)
    for i, j in zip(places.tolist(), (draws(seed, 0, n - 1) % (places + 1).astype(np.uint64)).tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def _orders(seeds: np.ndarray, n: int) -> np.ndarray:
    """The shuffles of several seeds, one a row: a step of all of them at a time, unless they are few."""
    if len(seeds) < LOCKSTEP:
        return np.array([call_order(int(s), n) for s in seeds], dtype=np.int32).reshape(len(seeds), n)
    order = np.repeat(np.arange(n, dtype=np.int32)[:, None], len(seeds), axis=1)
    run = np.arange(len(seeds))
    for step, i in enumerate(range(n - 1, 0, -1), 1):
        j = (_mixed(seeds + np.uint64(step * STEP % 2**64)) % np.uint64(i + 1)).astype(np.int64)
        drawn = order[j, run]
        order[j, run] = order[i]
        order[i] = drawn
    return order.T


def ordered(rows: DataFrame) -> DataFrame:
    """rows (n_calls, seed as decimal text) with `order`: a seeded shuffle of 0 .. n_calls - 1; null without a number or seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.and_(batch.column("n_calls").is_valid(), batch.column("seed").is_valid()).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(batch.column("n_calls"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            seeds = pc.cast(pc.fill_null(batch.column("seed"), "0"), pa.uint64()).to_numpy(zero_copy_only=False)
            before = np.cumsum(sizes) - sizes
            cuts = np.flatnonzero(np.diff(before // MOST_CALLS)) + 1  # pieces of few calls, or of one row
            for low, high in zip([0, *cuts], [*cuts, len(sizes)]):
                if low == high:
                    continue
                offsets = np.concatenate([[0], np.cumsum(sizes[low:high])])
                values = np.empty(offsets[-1], dtype=np.int32)
                for n in np.unique(sizes[low:high]):
                    at = np.flatnonzero(sizes[low:high] == n)
                    values[(offsets[at][:, None] + np.arange(n)).ravel()] = _orders(seeds[low:high][at], int(n)).ravel()
                made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array(~known[low:high]))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, made], [*batch.schema.names, "order"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("order", T.ArrayType(T.IntegerType()))]))


def call_orders(protocols: DataFrame) -> DataFrame:
    """protocol_id, place, call: the order of all calls of each protocol (n_calls, seed)."""
    made = ordered(protocols.select("protocol_id", F.col("n_calls").cast("long").alias("n_calls"), "seed"))
    return made.select("protocol_id", F.posexplode("order").alias("place", "call")).select("protocol_id", F.col("place").cast("long").alias("place"), F.col("call").cast("long").alias("call"))
