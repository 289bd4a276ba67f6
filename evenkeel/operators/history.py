"""Measurements over time: latest, trend, and pairs of nearby measurements of different models.

Dates at most `days` apart are found in three ways, none of which is a nested loop. All
pairs (`near`): dates fall into buckets one wider than the window, and one side is offered
to its own and the neighbouring buckets, so that each pair meets exactly once. Whether
there is any (`having_near`): one side becomes stretches of covered days, a short array a
key. The closest (`closest`): both sides are merged in order of day, and each row is
compared with the last and the next of the other side. The last two hold a row for each
day of a key at most, however many measurements that day has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.vocabulary import BRIDGE_WINDOW_DAYS
from evenkeel.operators.gates import compare

LINE = ["protocol_id", "series", "model_id"]
FIGURES = ["run_id", "run_date", "stability_pct", "ci_low_pct", "ci_high_pct", "bound_pct"]


def keyed(history: DataFrame) -> DataFrame:
    return history.where(F.col("protocol_id").isNotNull() & F.col("series").isNotNull())


def latest(history: DataFrame) -> DataFrame:
    """The last measurement (run_date, then run_id) of each protocol, series and model."""
    others = [c for c in history.columns if c not in LINE]
    newest = F.max_by(F.struct(*others), F.struct("run_date", "run_id")).alias("m")
    return keyed(history).groupBy(*LINE).agg(newest).select(*LINE, "m.*")


def numbered(history: DataFrame) -> DataFrame:
    """Place of each measurement in its line, and how many there are."""
    line = Window.partitionBy(*LINE)
    return keyed(history).select(*LINE, "run_id", "run_date", F.row_number().over(line.orderBy("run_date", "run_id")).alias("place"), F.count("*").over(line).alias("of"))


def trend(history: DataFrame) -> DataFrame:
    """Verdict and change of each measurement against the one before it; `base` where there is nothing to compare."""
    before = F.lag(F.struct(*FIGURES)).over(Window.partitionBy(*LINE).orderBy("run_date", "run_id"))
    rows = keyed(history).select(*LINE, F.struct(*FIGURES).alias("now"), before.alias("before"))
    lacks = F.col("before").isNull() | F.col("before.stability_pct").isNull() | F.col("now.stability_pct").isNull()
    return rows.select(
        *LINE,
        F.col("now.run_id").alias("run_id"),
        F.when(lacks, "base").otherwise(compare("before", "now")).alias("trend"),
        F.when(~lacks, F.col("now.stability_pct") - F.col("before.stability_pct")).alias("delta"),
    )


def _bucket(day: Column, days: int) -> Column:
    return F.floor(day_number(day) / F.lit(days + 1)).cast("long")


def near(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str, days: int = BRIDGE_WINDOW_DAYS) -> DataFrame:
    """Pairs of rows equal in `on` whose days are at most `days` apart."""
    mine = left.withColumn("_bucket", _bucket(F.col(left_day), days))
    home = _bucket(F.col(right_day), days)
    theirs = right.withColumn("_bucket", F.explode(F.array(home - 1, home, home + 1)))
    met = mine.join(theirs, [*on, "_bucket"]).where(F.abs(F.datediff(left_day, right_day)) <= days)
    return met.drop("_bucket")


def model_pairs(history: DataFrame, days: int = BRIDGE_WINDOW_DAYS) -> DataFrame:
    """Each two measurements of one protocol and series by different models, at most `days` apart: this, other, gap."""
    on = ["protocol_id", "series"]
    rows = keyed(history).where(F.col("run_date").isNotNull())
    side = lambda name: rows.select(*on, F.col("model_id").alias(f"{name}_model"), F.struct(*FIGURES).alias(name), F.col("run_date").alias(f"{name}_day"))
    met = near(side("this"), side("other"), on, "this_day", "other_day", days).where("this_model <> other_model")
    return met.withColumn("gap", F.abs(F.datediff("this_day", "other_day")))


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def stretches(numbers: Column, days: int = BRIDGE_WINDOW_DAYS) -> Column:
    """first and last of the stretches of days at most `days` from one of the day numbers (a sorted array without repeats)."""
    wide = 2 * days + 1
    begins = F.filter(numbers, lambda d, i: (i == 0) | (d - F.get(numbers, i - 1) > wide))
    ends = F.filter(numbers, lambda d, i: (i == F.size(numbers) - 1) | (F.get(numbers, i + 1) - d > wide))
    return F.zip_with(begins, ends, lambda b, e: F.struct((b - days).alias("first"), (e + days).alias("last")))


def within(number: Column, covered: Column) -> Column:
    return F.exists(covered, lambda s: (s["first"] <= number) & (number <= s["last"]))


def having_near(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str, days: int = BRIDGE_WINDOW_DAYS) -> DataFrame:
    """Rows of left for which right has a row equal in `on` and at most `days` apart."""
    covered = right.groupBy(*on).agg(F.sort_array(F.collect_set(day_number(F.col(right_day)))).alias("_days"))
    covered = covered.select(*on, stretches(F.col("_days"), days).alias("_covered"))
    return left.join(covered, on).where(within(day_number(F.col(left_day)), F.col("_covered"))).drop("_covered")


def closest(history: DataFrame, days: int = BRIDGE_WINDOW_DAYS) -> DataFrame:
    """this, other, gap: the closest two measurements of each two models of a protocol and series, in either order.

    Least gap first, then the later own date, then run ids. Measurements of one model and day are
    alike but for their run id, so that the first of them stands for the day; days of two
    models are merged and each is held against the last and the next of the other model.
    """
    on = ["protocol_id", "series"]
    daily = keyed(history).where(F.col("run_date").isNotNull() & F.col("model_id").isNotNull()).groupBy(*on, "model_id", "run_date").agg(F.min_by(F.struct(*FIGURES), "run_id").alias("this"))
    models = daily.select(*on, F.col("model_id").alias("other_model")).distinct()
    rows = daily.join(models, on).where("model_id <> other_model").withColumns({"low": F.least("model_id", "other_model"), "day": day_number(F.col("run_date"))})
    pair = [*on, "low", F.greatest("model_id", "other_model")]
    theirs = {}
    for name, order in (("before", F.col("day")), ("after", -F.col("day"))):
        seen = Window.partitionBy(*pair).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        of = lambda low: F.last(F.when((F.col("model_id") == F.col("low")) == F.lit(low), F.col("this")), ignorenulls=True).over(seen)  # noqa: E731, B023
        theirs |= {f"{name}_low": of(True), f"{name}_high": of(False)}
    rows = rows.withColumns(theirs)
    other = [F.when(F.col("model_id") == F.col("low"), F.col(f"{name}_high")).otherwise(F.col(f"{name}_low")) for name in ("before", "after")]
    met = rows.select(*on, F.col("model_id").alias("this_model"), "other_model", "this", "day", F.explode(F.array(*other)).alias("other"))
    met = met.withColumn("gap", F.abs(F.datediff("this.run_date", "other.run_date"))).where(F.col("gap") <= days)
    rank = F.struct("gap", (-F.col("day")).alias("late"), F.col("this.run_id").alias("a"), F.col("other.run_id").alias("b"))
    key = [*on, "this_model", "other_model"]
    best = met.groupBy(*key).agg(F.min_by(F.struct("this", "other", "gap"), rank).alias("pair"))
    return best.select(*key, "pair.*")


def bridges(history: DataFrame, days: int = BRIDGE_WINDOW_DAYS) -> DataFrame:
    """The closest pair for each two models, with its verdict."""
    key = ["protocol_id", "series", "this_model", "other_model"]
    return closest(history, days).select(*key, F.col("this.run_id").alias("this_run"), F.col("other.run_id").alias("other_run"), "gap", compare("other", "this").alias("verdict"))


def other_models(history: DataFrame) -> DataFrame:
    """For each line, every other model's latest measurement of the same protocol and series, and the days between."""
    now = latest(history).select(*LINE, "run_id", "run_date")
    other = now.select("protocol_id", "series", F.col("model_id").alias("other_model"), F.col("run_id").alias("other_run"), F.col("run_date").alias("other_day"))
    met = now.join(other, ["protocol_id", "series"]).where("model_id <> other_model")
    return met.select(*LINE, "run_id", "other_model", "other_run", F.abs(F.datediff("run_date", "other_day")).alias("days_apart"))


def panel_bridges(old: DataFrame, new: DataFrame, days: int = BRIDGE_WINDOW_DAYS) -> DataFrame:
    """Runs on an old panel and runs of its successor (joined by `successor`) on one model within the window."""
    o = old.select("successor", "model_id", F.col("protocol_id").alias("old_protocol"), F.col("run_id").alias("old_run"), F.col("run_date").alias("old_day"))
    n = new.select(F.col("protocol_id").alias("successor"), "model_id", F.col("run_id").alias("new_run"), F.col("run_date").alias("new_day"))
    return near(o, n, ["successor", "model_id"], "old_day", "new_day", days)


def panel_compare(pairs: DataFrame, x: str, y: str, day_x: str, day_y: str, days: int = BRIDGE_WINDOW_DAYS) -> DataFrame:
    """flat or differs for two measurements of different panels, with the change at one place and the window kept or not."""
    verdict = compare(x, y)
    return pairs.withColumns({
        "result": F.when(verdict == "flat", "flat").when(verdict.isNotNull(), "differs"),
        "delta": F.round(F.col(f"{y}.stability_pct") - F.col(f"{x}.stability_pct"), 1),
        "days_apart": F.abs(F.datediff(day_x, day_y)),
    }).withColumn("in_window", F.col("days_apart") <= days)
