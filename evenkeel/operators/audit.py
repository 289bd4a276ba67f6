"""Audits: what was stored against what the data give today."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.sources.tables import materialize


def field_diff(stored: DataFrame, rebuilt: DataFrame, key: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """key with the names of the fields that differ (nulls compare equal to nulls); rows on one side only say so."""
    fields = [c for c in stored.columns if c not in key and c not in ignore]
    a = stored.select(*key, F.struct(*fields).alias("a"))
    b = rebuilt.select(*key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    lone = F.when(F.col("b").isNull(), F.array(F.lit("not_rebuilt"))).when(F.col("a").isNull(), F.array(F.lit("not_stored")))
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields)))
    return both.select(*key, F.coalesce(lone, names).alias("differs"))


def off_by(published: DataFrame, recomputed: DataFrame, key: str | list[str], value: str, tolerance: float) -> DataFrame:
    """key, published and recomputed value, and whether they agree; nulls agree with nulls."""
    key = [key] if isinstance(key, str) else key
    both = published.select(*key, F.col(value).alias("published")).join(recomputed.select(*key, F.col(value).alias("recomputed")), key, "left")
    near = F.coalesce(F.abs(F.col("published") - F.col("recomputed")) <= tolerance, F.col("published").isNull() & F.col("recomputed").isNull())
    return both.withColumn("agrees", near)


def schedule_check(scheduled: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """key with the calls scheduled and kept, and the first place where they part (null: nowhere)."""
    s = scheduled.select(*key, "place", F.col("call").alias("want"))
    k = kept.select(*key, "place", F.col("call").alias("have"))
    both = s.join(k, [*key, "place"], "full")
    return both.groupBy(*key).agg(F.count("want").alias("scheduled"), F.count("have").alias("kept"), F.min(F.when(~F.col("want").eqNullSafe(F.col("have")), F.col("place"))).alias("parts_at"))


def numbered(rows: DataFrame, by: str, order: str, start: int = 0) -> DataFrame:
    """rows with place: their number within `by` in order of `order`, however many one value of `by` has.

    Rows are sorted over all tasks and written; a row's number is its distance from the first of
    its group in its own task, after what earlier tasks hold of that group.
    """
    ranked = materialize(rows.orderBy(by, order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}), "numbered")
    pieces = ranked.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that holds the group
    offsets = pieces.select(by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_row") - F.col("_first") + start
    return ranked.join(offsets, [by, "_part"]).withColumn("place", place).drop("_part", "_row", "_first", "_before")


def reclassified(stored: DataFrame, fresh: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """by: trials, and those whose stored outcome, token or reason differs from a fresh one."""
    told = lambda side: F.struct("outcome", "token", "reason").alias(side)
    both = stored.select(*key, told("a")).join(fresh.select(*key, told("b")), key)
    return both.groupBy(*by).agg(F.count("*").alias("trials"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
