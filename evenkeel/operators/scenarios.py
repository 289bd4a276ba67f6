"""Per-scenario gaps of a run, their spread and concentration.

Gaps have different denominators; sums are taken over the products of each gap's exact
numerator with the others' least common denominator only in published form (six places),
while shares are computed from doubles of exact quotients, as published figures are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.exact import published
from evenkeel.operators.counts import OPTIONS, distance, tally


def gaps(trials: DataFrame, panels: DataFrame | None = None, options: list[str] = OPTIONS) -> DataFrame:
    """run_id, scenario_id, gap_pct of every scenario of a run's panel (run_id, scenario_id); one without trials has a null gap.

    Without panels the scenarios that a run has trials of are its panel.
    """
    found = cell_gaps(tally(trials, ["run_id", "scenario_id"], options))
    return found if panels is None else panels.join(found, ["run_id", "scenario_id"], "left")


def cell_gaps(cells: DataFrame) -> DataFrame:
    """run_id, scenario_id, gap_pct of trials counted by run and scenario."""
    num, den = distance(F.col("c_A"), F.col("c_B"))
    return cells.select("run_id", "scenario_id", published(num * 100, den).alias("gap_pct"))


def spread(found: DataFrame) -> DataFrame:
    """min, nearest-rank quartiles, median and max of each run's known gaps."""
    g = F.col("gap_pct")
    rows = found.where(g.isNotNull()).groupBy("run_id").agg(
        F.count("*").alias("known"),
        F.min(g).alias("min_pct"),
        F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY gap_pct)").alias("q1_pct"),
        F.round(F.median(g), 6).alias("median_pct"),
        F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY gap_pct)").alias("q3_pct"),
        F.max(g).alias("max_pct"),
    )
    return rows.withColumn("iqr_pct", F.round(F.col("q3_pct") - F.col("q1_pct"), 6))


def concentration(found: DataFrame) -> DataFrame:
    """Share of a run's summed gap that its two largest scenarios hold; null if the sum is 0."""
    largest = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("gap_pct"), "scenario_id")
    ranked = found.withColumn("place", F.row_number().over(largest))
    rows = ranked.groupBy("run_id").agg(F.sum(F.when(F.col("place") <= 2, F.col("gap_pct"))).alias("top"), F.sum("gap_pct").alias("all"))
    return rows.select("run_id", F.round(100 * F.col("top") / F.nullif(F.col("all"), F.lit(0.0)), 5).alias("concentration_pct"))


def ranked(found: DataFrame) -> DataFrame:
    """Scenarios of each run from the largest gap down, unknown ones last."""
    order = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("gap_pct"), "scenario_id")
    return found.withColumn("place", F.row_number().over(order))
