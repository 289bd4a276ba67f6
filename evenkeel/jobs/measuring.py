"""Queries that put a measurement together, and the records around it. Each has its SQL beside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import hashing as S
from evenkeel.functions.exact import published
from evenkeel.functions.vocabulary import COST_PER_CALL_EUR
from evenkeel.jobs import counting
from evenkeel.operators import counts, gates, history as H, logs as L, resampling as R
from evenkeel.sources.derived import history, observations, protocols, registry, responses, trials, with_views
from evenkeel.sources.tables import materialize, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def measured(rows: DataFrame, iterations: int = R.ITERATIONS) -> DataFrame:
    """rows of counts.with_pairs with a seed -> stability, its interval, the noise floor and whether it is reached.

    One stream of draws serves a row: the bootstrap first, then the null floor.
    """
    runs = materialize(rows.select("run_id", F.col("c_A").alias("cx"), F.col("c_B").alias("cy"), "seed"), "measured-runs")
    ci, floor = R.bootstrap(runs, iterations), R.null_floor(runs, iterations, after_bootstrap=iterations)
    both = rows.join(ci, "run_id", "left").join(floor, "run_id", "left")
    upper = lambda num, den: published((den - num) * 100, den)
    gap_n, gap_d = F.col("gap_num_ab"), F.col("gap_den_ab")
    # stability >= 100 - floor is the same as gap <= floor, compared exactly
    reached = gap_n * F.col("floor_den").cast("decimal(38,0)") <= F.col("floor_num").cast("decimal(38,0)") * gap_d
    return both.select(
        "run_id",
        counts.stability().alias("stability_pct"),
        upper(F.col("high_num"), F.col("den")).alias("ci_low_pct"),
        upper(F.col("low_num"), F.col("den")).alias("ci_high_pct"),
        published(F.col("floor_num") * 100, F.col("floor_den")).alias("null_floor_pct"),
        reached.alias("at_noise_floor"),
    )


@query()
def op_measurement(spark: SparkSession, folder: str) -> DataFrame:
    rows = counts.with_pairs(counts.tally(trials(spark, folder), ["run_id"]))
    return measured(rows.withColumn("seed", S.seed(F.col("run_id"), F.lit("2026-01-31"), F.lit("model"))))


@query(with_views("trials", """, t AS (SELECT run_id, outcome, token, CASE WHEN outcome = 'valid' THEN token = CASE WHEN scenario_id < 's08' THEN 'A' ELSE 'B' END END AS correct FROM trials)
SELECT run_id, count(*) FILTER (WHERE outcome = 'valid') AS valid, count(*) FILTER (WHERE outcome <> 'valid') AS lost, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE NOT correct) AS incorrect FROM t GROUP BY run_id"""))
def op_fingerprint_scores(spark: SparkSession, folder: str) -> DataFrame:
    right = F.when(F.col("outcome") == "valid", F.col("token") == F.when(F.col("scenario_id") < "s08", "A").otherwise("B"))
    rows = trials(spark, folder).select("run_id", "outcome", right.alias("right"))
    return rows.groupBy("run_id").agg(F.count_if(F.col("outcome") == "valid").alias("valid"), F.count_if(F.col("outcome") != "valid").alias("lost"), F.count_if("right").alias("correct"), F.count_if(~F.col("right")).alias("incorrect"))


@query(with_views("responses", """, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM responses WHERE text IS NOT NULL AND trim(text, ' ' || chr(10)) <> '') SELECT conv_id, turn, sha256(text) AS text_sha256 FROM r WHERE n = 1"""))
def op_example_texts(spark: SparkSession, folder: str) -> DataFrame:
    some = responses(spark, folder).where(F.regexp_replace("text", r"[ \n]+", "") != "")
    return some.groupBy("conv_id").agg(F.min_by(F.struct("turn", F.sha2("text", 256).alias("text_sha256")), "turn").alias("t")).select("conv_id", "t.*")


@query(with_views("protocols", " SELECT place, CAST(n AS BIGINT) * 4 AS calls, CAST(CAST(n AS BIGINT) * 4 * 66 AS DOUBLE) / 10000 AS cost_eur FROM protocols WHERE status = 'admitted'"))
def op_projected_cost(spark: SparkSession, folder: str) -> DataFrame:
    calls = F.col("n").cast("long") * 4
    cost = calls.cast("decimal(18,0)") * F.lit(COST_PER_CALL_EUR).cast("decimal(10,4)")
    return protocols(spark, folder).where("status = 'admitted'").select("place", calls.alias("calls"), cost.cast("double").alias("cost_eur"))


_OWED = """, w AS (SELECT DISTINCT family, model_id FROM registry WHERE event = 'bridge_waived'), z AS (SELECT family, model_id, arg_max(event, place) AS e FROM registry WHERE event IN ('baseline', 'appeared', 'gone') GROUP BY ALL),
o AS (SELECT DISTINCT 'model_' || (CAST(substr(model_id, 2) AS INTEGER) % 2 + 1) AS new_model, 'p' || lpad(CAST(CAST(substr(model_id, 2) AS INTEGER) AS VARCHAR), 2, '0') AS protocol_id FROM z WHERE e = 'appeared' AND NOT EXISTS (SELECT 1 FROM w WHERE w.family = z.family AND w.model_id = z.model_id))"""


@query(with_views("registry history", _OWED + """ SELECT new_model, protocol_id FROM o WHERE NOT EXISTS (SELECT 1 FROM history n JOIN history c ON c.protocol_id = n.protocol_id AND c.model_id = 'model_0' AND c.series = n.series AND c.on_curve AND n.on_curve AND abs(date_diff('day', n.run_date, c.run_date)) <= 7
  WHERE n.protocol_id = o.protocol_id AND n.model_id = o.new_model)"""))
def op_bridge_missing(spark: SparkSession, folder: str) -> DataFrame:
    k = F.substr("model_id", F.lit(2)).cast("int")
    owed = L.owed(registry(spark, folder)).select(F.concat(F.lit("model_"), (k % 2 + 1).cast("string")).alias("new_model"), F.concat(F.lit("p"), F.lpad(k.cast("string"), 2, "0")).alias("protocol_id")).distinct()
    rows = history(spark, folder)
    new = rows.where("model_id <> 'model_0' and on_curve").select("protocol_id", "series", F.col("model_id").alias("new_model"), F.col("run_date").alias("new_day"))
    now = rows.where("model_id = 'model_0' and on_curve").select("protocol_id", "series", F.col("run_date").alias("now_day"))
    done = H.having_near(new, now, ["protocol_id", "series"], "new_day", "now_day").select("new_model", "protocol_id").distinct()
    return owed.join(done, ["new_model", "protocol_id"], "left_anti")


@query(with_views("history observations", """, a AS (SELECT DISTINCT strftime(run_date, '%Y-%m') AS month FROM history), m AS (SELECT DISTINCT strftime(run_date, '%Y-%m') AS month FROM history WHERE model_id = 'model_2' AND protocol_id < 'p15'),
g AS (SELECT DISTINCT strftime(day - INTERVAL 26 YEAR, '%Y-%m') AS month FROM observations WHERE cause = 'budget_halted') SELECT month FROM a WHERE month NOT IN (SELECT month FROM m) AND month NOT IN (SELECT month FROM g)"""))
def op_gap_log_due(spark: SparkSession, folder: str) -> DataFrame:
    month = lambda day: F.date_format(day, "yyyy-MM").alias("month")
    rows = history(spark, folder)
    ran = rows.where("model_id = 'model_2' and protocol_id < 'p15'").select(month("run_date"))
    noted = observations(spark, folder).where("cause = 'budget_halted'").select(month(F.add_months("day", -26 * 12)))
    return rows.select(month("run_date")).distinct().join(ran.unionByName(noted).distinct(), "month", "left_anti")


@query(""" WITH p AS (SELECT DISTINCT sha256(text) AS sha FROM conversations WHERE turn % 2 = 0) SELECT conv_id, turn, sha256(text) AS text_sha256 FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.sha = sha256(c.text))""")
def op_unpublished(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"))
    known = rows.where("turn % 2 = 0").select("text_sha256").distinct()
    return rows.join(known, "text_sha256", "left_anti").select("conv_id", "turn", "text_sha256")


def synthetic_tokens(calls: DataFrame, chance: Column) -> DataFrame:
    """calls (seed as decimal text) with a token: A if the seed's first draw falls under `chance` thousandths."""

    @F.pandas_udf("string")
    def token(seed: pd.Series, limit: pd.Series) -> pd.Series:
        z = np.array([int(s) for s in seed], dtype=np.uint64) + np.uint64(R.STEP)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(R.FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(R.SECOND)
        z ^= z >> np.uint64(31)
        return pd.Series(np.where((z % np.uint64(1000)).astype(np.int64) < limit.to_numpy(), "A", "B"))

    return calls.withColumn("token", token("seed", chance))


@query(""" WITH c AS (SELECT p_partkey AS place, v AS version, 100 + p_size * 10 AS chance, CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR) || '‖' || v), 1, 16) AS UBIGINT)::UHUGEINT AS seed FROM part CROSS JOIN (SELECT unnest(['A', 'B']) AS v)),
z0 AS (SELECT *, (seed + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM c),
z1 AS (SELECT * REPLACE ((xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM z0),
z2 AS (SELECT * REPLACE ((xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM z1)
SELECT place, version, CASE WHEN xor(z, z >> 31) % 1000::UHUGEINT < chance::UHUGEINT THEN 'A' ELSE 'B' END AS token FROM z2""")
def op_synthetic_replies(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "part").select(F.col("p_partkey").alias("place"), (100 + F.col("p_size") * 10).alias("chance"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("version"))
    seeded = calls.withColumn("seed", S.seed(F.col("place").cast("string"), F.col("version")))
    return synthetic_tokens(seeded, F.col("chance")).select("place", "version", "token")


@query(with_views("history", """, s AS (SELECT * FROM (SELECT *, sha256(CAST(run_date AS VARCHAR) || ':' || run_id) AS h FROM history) QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY h) <= 2)
SELECT CAST(run_date AS VARCHAR) AS day, count(*) AS checked, count(*) FILTER (WHERE stability_pct IS NULL) AS without_figures, count(*) FILTER (WHERE ci_high_pct > 100) AS out_of_range FROM s GROUP BY run_date"""))
def op_daily_revalidation(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    day = F.col("run_date").cast("string")
    order = Window.partitionBy("run_date").orderBy(S.sample_order(day, F.col("run_id")))
    chosen = history(spark, folder).withColumn("r", F.row_number().over(order)).where("r <= 2")
    return chosen.groupBy(day.alias("day")).agg(F.count("*").alias("checked"), F.count_if(F.col("stability_pct").isNull()).alias("without_figures"), F.count_if(F.col("ci_high_pct") > 100).alias("out_of_range"))


@query(with_views("protocols history", """, c AS (SELECT place, protocol_id, place % 97 AS k FROM protocols WHERE status = 'admitted'), r AS (SELECT CAST(substr(protocol_id, 2) AS INTEGER) AS k, max(run_date) AS last_run FROM history WHERE model_id = 'model_1' AND series = 'commercial' AND on_curve GROUP BY 1)
SELECT c.place, CAST(r.last_run AS VARCHAR) AS last_run, row_number() OVER (ORDER BY coalesce(CAST(r.last_run AS VARCHAR), ''), c.protocol_id, c.place) AS turn FROM c LEFT JOIN r USING (k)"""))
def op_sweep_order(spark: SparkSession, folder: str) -> DataFrame:
    last = history(spark, folder).where("model_id = 'model_1' and series = 'commercial' and on_curve").groupBy(F.substr("protocol_id", F.lit(2)).cast("long").alias("k")).agg(F.max("run_date").cast("string").alias("last_run"))
    rows = protocols(spark, folder).where("status = 'admitted'").select("place", "protocol_id", (F.col("place") % 97).alias("k")).join(last, "k", "left")
    # sort once over all tasks, then number rows from each partition's offset: no single task sees them all
    ranked = rows.select("place", "protocol_id", "last_run", F.coalesce("last_run", F.lit("")).alias("since")).orderBy("since", "protocol_id", "place")
    ranked = materialize(ranked.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}), "sweep-order")
    from pyspark.sql import Window

    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ranked.join(F.broadcast(offsets), "part").select("place", "last_run", (F.col("offset") + F.col("row") + 1).alias("turn"))


@query(with_views("trials", counting._GATED + """, a AS (SELECT run_id, unnest(flags) AS flag FROM e) SELECT e.series, a.flag, count(*) AS runs, min(e.run_id) AS first_run FROM a JOIN e USING (run_id) WHERE e.lane <> 'sealed' GROUP BY ALL"""))
def op_flags_by_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = counting.gated(spark, folder).where("lane <> 'sealed'")
    return rows.select("series", "run_id", F.explode("flags").alias("flag")).groupBy("series", "flag").agg(F.count("*").alias("runs"), F.min("run_id").alias("first_run"))


@query(with_views("history", """, l AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY protocol_id, series, model_id ORDER BY run_date, run_id) AS r FROM history) WHERE r = 1),
t AS (SELECT h.protocol_id, h.series, h.model_id, l.stability_pct AS x_s, l.ci_low_pct AS x_l, l.ci_high_pct AS x_h, l.bound_pct AS x_b, h.stability_pct AS y_s, h.ci_low_pct AS y_l, h.ci_high_pct AS y_h, h.bound_pct AS y_b FROM history h JOIN l USING (protocol_id, series, model_id)),
v AS (SELECT *, CASE WHEN abs(y_s - x_s) >= sqrt(((x_h - x_l) / 2) * ((x_h - x_l) / 2) + ((y_h - y_l) / 2) * ((y_h - y_l) / 2)) AND abs(y_s - x_s) > x_b + y_b THEN 'moved' WHEN x_s IS NOT NULL AND y_s IS NOT NULL THEN 'flat' ELSE 'unknown' END AS margin FROM t)
SELECT series, model_id, margin, count(*) AS measurements FROM v GROUP BY ALL"""))
def op_guard_margin(spark: SparkSession, folder: str) -> DataFrame:
    rows = history(spark, folder)
    first = rows.groupBy(*H.LINE).agg(F.min_by(F.struct(*H.FIGURES), F.struct("run_date", "run_id")).alias("base"))
    both = rows.select(*H.LINE, F.struct(*H.FIGURES).alias("now")).join(first, H.LINE)
    verdict = gates.compare("base", "now")
    margin = F.when(verdict == "flat", "flat").when(verdict.isNotNull(), "moved").otherwise("unknown")
    return both.select("series", "model_id", margin.alias("margin")).groupBy("series", "model_id", "margin").agg(F.count("*").alias("measurements"))
