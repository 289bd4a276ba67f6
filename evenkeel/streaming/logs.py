"""Streams over append-only logs: daily checks, silence, breakers and alarms as they come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evenkeel.operators.logs import MOST_FAILURES, call_faults
from evenkeel.sources.records import OBSERVATION


def observation_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New log files of a folder, as a stream."""
    return spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_batch).json(folder)


def daily_checks(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """day, ran, of: final once the watermark has passed a day."""
    timed = stream.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", "1 day").alias("w")).agg(F.count_if("ran").alias("ran"), F.count("*").alias("of"))
    return counts.select(F.to_date("w.start").alias("day"), "ran", "of")


def activity_gaps(stream: DataFrame, key: str, at: str, silence: str = "36 hours", late: str = "36 hours") -> DataFrame:
    """Sessions of activity of each key: one ends where nothing came for `silence`."""
    timed = stream.withWatermark(at, late)
    return timed.groupBy(key, F.session_window(at, silence).alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("first"), F.col("s.end").alias("silent_from"), "events")


def run_stops(stream: DataFrame, by: str, order: str) -> DataFrame:
    """by, stopped_at, why as soon as a run's breaker ends it; the rows of the batch `run_stops`.

    A run's state is its failed calls in a row and whether it has ended; wherever the log is cut
    into batches, the streak goes on. Calls of a run come in order from one batch to the next.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, over = state.get if state.exists else (0, False)
        calls = pd.concat(list(parts)).sort_values("at")
        for at, failed, fault in zip(calls["at"], calls["failed"], calls["fault"]):
            if over:
                break
            streak = streak + 1 if failed else 0
            why = fault if isinstance(fault, str) else "failures" if streak >= MOST_FAILURES else None
            if failed and why:
                over = True
                yield pd.DataFrame({by: [key[0]], "stopped_at": [at], "why": [why]})
        state.update((streak, over))

    calls = stream.select(by, F.col(order).cast("long").alias("at"), "failed", call_faults().alias("fault"))
    kind = calls.schema[by].dataType.simpleString()
    return calls.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, stopped_at long, why string", "streak int, over boolean", "append", GroupStateTimeout.NoTimeout)


def silences(stream: DataFrame, by: str, at: str, hours: int, late: str = "0 hours") -> DataFrame:
    """by, last, silent_at: a row for each time that nothing came for more than `hours` hours.

    A timer is set at the last line's time and raises the alarm once the log's own time has
    passed it, also for a key of which nothing more ever comes; a later line may find the
    silence first. Every stretch of silence is told once.
    """
    spare = hours * 3_600_000_000  # microseconds, as all times here

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        found = []
        if state.hasTimedOut:
            found, told = ([] if told else [last]), True
        else:
            for now in sorted(int(x) for x in pd.concat(list(parts))["micros"]):
                if last is not None and now - last > spare and not told:
                    found.append(last)
                if last is None or now > last:
                    last, told = now, False
        state.update((last, told))
        if not told:
            state.setTimeoutTimestamp(max((last + spare) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({by: [key[0]] * len(found), "last": found})

    rows = stream.select(by, F.col(at).alias("ts"), F.unix_micros(at).alias("micros")).withWatermark("ts", late)
    kind = rows.schema[by].dataType.simpleString()
    told = rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, last long", "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(by, F.timestamp_micros("last").alias("last"), F.timestamp_micros(F.col("last") + spare).alias("silent_at"))


def append_each(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that adds each batch to a table exactly once: batches are named by their number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
