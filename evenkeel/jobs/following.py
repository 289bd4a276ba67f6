"""Queries over rows that follow a measurement: joined outcomes, display rows, promotions, spending, bridge steps. Each has its SQL beside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.functions import hashing as S
from evenkeel.functions.vocabulary import COST_PER_CALL_EUR
from evenkeel.jobs import counting, publish, reading, tracking
from evenkeel.jobs.measuring import _OWED
from evenkeel.operators import admission, history as H, logs as L, protocols as P, resampling as R
from evenkeel.sources.derived import history, ledger, observations, protocols, registry, with_views
from evenkeel.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(with_views("history", """, o AS (SELECT 'r' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS run_id, l_returnflag AS outcome, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT run_id, protocol_id, series, stability_pct, outcome, n FROM o JOIN history USING (run_id)"""))
def op_outcome_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome rows with the figures of their measurement; counted before they meet it."""
    outcomes = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    keyed = outcomes.select(F.concat(F.lit("r"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("run_id"), F.col("l_returnflag").alias("outcome"), "n")
    return keyed.join(history(spark, folder).select("run_id", "protocol_id", "series", "stability_pct"), "run_id")


@query(with_views("history", tracking._LATEST + """ SELECT protocol_id, series, model_id, run_id, CASE model_id WHEN 'model_0' THEN 'active' WHEN 'model_1' THEN 'retired' END AS model_status,
  CAST(row_number() OVER (PARTITION BY protocol_id ORDER BY series, model_id <> 'model_0', model_id) AS INTEGER) AS place FROM l"""))
def op_display_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Latest rows with their model's status, numbered within a protocol: by series, the current model first."""
    generations = spark.createDataFrame([("model_0", "active"), ("model_1", "retired")], "model_id string, model_status string")
    rows = H.latest(history(spark, folder)).join(F.broadcast(generations), "model_id", "left")
    order = Window.partitionBy("protocol_id").orderBy("series", ~F.coalesce(F.col("model_status") == "active", F.lit(False)), "model_id")
    return rows.select("protocol_id", "series", "model_id", "run_id", "model_status", F.row_number().over(order).alias("place"))


@query(with_views("history", " SELECT CAST(run_date AS VARCHAR) AS day, protocol_id, model_id, printf('%.1f%%', stability_pct) AS stability FROM history WHERE stability_pct IS NOT NULL"))
def op_published_table(spark: SparkSession, folder: str) -> DataFrame:
    """The readers' table of measurements, in order of date and protocol."""
    rows = history(spark, folder).where("stability_pct is not null")
    shown = F.format_string("%.1f%%", F.bround("stability_pct", 1))
    return rows.orderBy("run_date", "protocol_id").select(F.col("run_date").cast("string").alias("day"), "protocol_id", "model_id", shown.alias("stability"))


@query(with_views("trials", counting._GATED + " SELECT run_id, CAST(len(flags) AS INTEGER) AS n_flags, flags[1] AS first_flag, reading, all_passed, CAST(v_A AS BIGINT) AS valid_a, CAST(v_B AS BIGINT) AS valid_b FROM e"))
def op_parsed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Published cells read back: JSON, booleans and numbers as they were before."""
    rows = counting.gated(spark, folder)
    cells = publish.csv_cells(rows.select("run_id", "flags", "reading", "all_passed", F.create_map(F.lit("A"), F.col("valid_A"), F.lit("B"), F.col("valid_B")).alias("n_valid")))
    back = publish.parsed_cells(cells, "run_id string, flags array<string>, reading boolean, all_passed boolean, n_valid map<string,bigint>")
    return back.select("run_id", F.size("flags").alias("n_flags"), F.get("flags", F.lit(0)).alias("first_flag"), "reading", "all_passed", F.col("n_valid.A").alias("valid_a"), F.col("n_valid.B").alias("valid_b"))


_LOGPROB = "-l_discount * [0.004, 0.1, 1.0][1 + l_linenumber % 3] - [0.0, 0.0003, 1e-9][1 + l_orderkey % 3]"  # about -0.0 to -0.1, many under a thousandth
# What stands for the reply's letters beyond ASCII.
_ODD_REPLY, _ODD_ESCAPED = "reply é \U0001f600 ", r"reply \u00e9 \ud83d\ude00 "


@query(f""" WITH t AS (SELECT l_orderkey, '{{"' || l_returnflag || '":' || CAST(round({_LOGPROB}, 4) AS VARCHAR) || ',"x' || l_linestatus || '\\u00e9":' || round(-(l_tax + 1), 4) || '}}' AS step, l_linenumber, l_returnflag, {_LOGPROB} AS la, l_linestatus, l_tax FROM lineitem)
SELECT l_orderkey AS prompt, sha256('{{"text":"{_ODD_ESCAPED}' || l_orderkey || '","tokens":[' || string_agg(step, ',' ORDER BY l_linenumber, l_returnflag, la, l_linestatus, l_tax DESC) || ']}}') AS fingerprint FROM t GROUP BY l_orderkey""")
def op_logprob_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    one_of = lambda key, *values: F.element_at(F.array(*map(F.lit, values)), (1 + F.col(key) % 3).cast("int"))
    logprob = -F.col("l_discount") * one_of("l_linenumber", 0.004, 0.1, 1.0) - one_of("l_orderkey", 0.0, 0.0003, 1e-9)
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", logprob.alias("la"), "l_tax")
    step = F.struct("l_linenumber", F.col("l_returnflag").alias("a"), "la", F.concat(F.lit("x"), "l_linestatus", F.lit("é")).alias("b"), (-(F.col("l_tax") + 1)).alias("lb"))
    steps = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    maps = F.transform("steps", lambda s: F.create_map(s["b"], s["lb"], s["a"], s["la"]))
    return steps.select(F.col("l_orderkey").alias("prompt"), S.logprob_fingerprint(F.concat(F.lit(_ODD_REPLY), F.col("l_orderkey").cast("string")), maps).alias("fingerprint"))


@query(""" WITH c AS (SELECT p_partkey AS item, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS truth, CAST('0x' || substr(sha256('fingerprint‖' || p_partkey), 1, 16) AS UBIGINT)::UHUGEINT AS seed FROM part),
z0 AS (SELECT *, (seed + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM c),
z1 AS (SELECT * REPLACE ((xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM z0),
z2 AS (SELECT * REPLACE ((xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z) FROM z1),
r AS (SELECT item, truth, CAST(xor(z, z >> 31) AS DOUBLE) / 18446744073709551616.0 AS r FROM z2)
SELECT item, CASE WHEN r < 0.02 THEN 'refused' WHEN r < 0.04 THEN 'truncated' WHEN r < 0.07 THEN 'unparseable' ELSE 'valid' END AS outcome,
  CASE WHEN r < 0.07 THEN NULL WHEN r < 0.12 THEN CASE truth WHEN 'yes' THEN 'no' ELSE 'yes' END ELSE truth END AS token FROM r""")
def op_synthetic_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded yes/no answers: 2 % refused, 2 % cut off, 3 % without a decision, 5 % wrong."""

    @F.pandas_udf("double")
    def share(seed: pd.Series) -> pd.Series:
        return pd.Series([float(R.draws(int(s), 0, 1)[0]) / 2.0**64 for s in seed], dtype=np.float64)

    items = table(spark, folder, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no").alias("truth"))
    r = F.col("r")
    rows = items.withColumn("r", share(S.seed(F.lit("fingerprint"), F.col("item").cast("string"))))
    outcome = F.when(r < 0.02, "refused").when(r < 0.04, "truncated").when(r < 0.07, "unparseable").otherwise("valid")
    wrong = F.when(F.col("truth") == "yes", "no").otherwise("yes")
    return rows.select("item", outcome.alias("outcome"), F.when(r < 0.07, F.lit(None).cast("string")).when(r < 0.12, wrong).otherwise(F.col("truth")).alias("token"))


@query(f""" WITH a AS ({reading.SQL['op_admission']}), p AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 9 = 0 THEN 'candidate' ELSE 'admitted' END AS status, ['open', 'guard', 'sealed', 'hidden'][1 + p_partkey % 4] AS new_lane,
  CASE WHEN p_partkey % 8 <> 0 THEN 'p' || (p_partkey + p_partkey % 7) END AS new_twin FROM part)
SELECT p.place, CASE WHEN status <> 'candidate' THEN 'not_candidate' WHEN new_lane = 'hidden' THEN 'unknown_lane' WHEN len(list_filter(string_split(broken, ','), lambda b: b NOT IN ('', 'candidate_has_twin', 'own_twin'))) > 0 OR scenario_faults <> '' THEN 'fails_before'
  WHEN (new_lane = 'open' AND new_twin IS NULL) OR new_twin = 'p' || p.place THEN 'fails_after' ELSE 'promoted' END AS outcome FROM p JOIN a ON a.place = p.place""")
def op_promotion(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("place")
    lane = F.element_at(F.array(*map(F.lit, ("open", "guard", "sealed", "hidden"))), (1 + k % 4).cast("int"))
    twin = F.when(k % 8 != 0, F.concat(F.lit("p"), (k + k % 7).cast("string")))
    unpaired = reading.declared_protocols(spark, folder).withColumn("twin_id", F.when(F.col("status") != "candidate", F.col("twin_id")))
    return admission.promote(unpaired, lane, twin)


@query(""" WITH c AS (SELECT conv_id, sum(coalesce(length(text), 0)) AS tin, sum(turn * 37) AS tout, CASE conv_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 15 END AS pin, CASE conv_id % 4 WHEN 0 THEN 15 WHEN 1 THEN 5 WHEN 2 THEN 75 END AS pout FROM conversations GROUP BY conv_id),
e AS (SELECT *, CAST(CAST(tin * pin + tout * pout + 99 AS BIGINT) // 100 AS DOUBLE) / 10000 AS amount FROM c)
SELECT 'run_' || conv_id AS run_id, 'sweep' AS category, amount, 'sweep; tokens x list price (' || CAST(tin AS BIGINT) || ' in / ' || CAST(tout AS BIGINT) || ' out), not yet reconciled' AS note FROM e WHERE amount > 0""")
def op_spend_entries(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("conv_id") % 4
    price = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).when(k == 2, c)
    used = table(spark, folder, "conversations").groupBy("conv_id").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("tokens_in"), F.sum(F.col("turn") * 37).alias("tokens_out"))
    runs = used.select(F.concat(F.lit("run_"), F.col("conv_id").cast("string")).alias("run_id"), F.lit("sweep").alias("category"), "tokens_in", "tokens_out", price(3, 1, 15).alias("price_in"), price(15, 5, 75).alias("price_out"))
    return L.spend_entries(runs)


@query(f""" SELECT family, model_id, '{{"event":"' || change || '","family":"' || family || '","model_id":"' || model_id || '","observed_date":"2026-01-31","record_type":"model_observed"}}' AS line,
  change = 'appeared' AS bridge_needed FROM ({tracking.SQL['op_model_diff']}) d""")
def op_registry_events(spark: SparkSession, folder: str) -> DataFrame:
    return L.registry_events(tracking.op_model_diff(spark, folder), F.lit("2026-01-31"))


@query(with_views("registry history ledger observations", _OWED + """, d AS (SELECT DISTINCT n.model_id AS new_model, n.protocol_id FROM history n JOIN history c ON c.protocol_id = n.protocol_id AND c.model_id = 'model_0' AND n.model_id <> 'model_0' AND c.series = n.series AND c.on_curve AND n.on_curve
  AND abs(date_diff('day', n.run_date, c.run_date)) <= 7),
m AS (SELECT o.new_model, o.protocol_id, strftime(max(h.run_date), '%Y-%m') AS month FROM o JOIN d USING (new_model, protocol_id) JOIN history h ON h.model_id = o.new_model AND h.protocol_id = o.protocol_id AND h.on_curve GROUP BY ALL),
s AS (SELECT *, new_model = 'model_1' AS listed, month IN (SELECT strftime(run_date, '%Y-%m') FROM ledger WHERE category = 'bridge' GROUP BY 1 HAVING sum(cents) > 0) AS billed,
  month IN (SELECT strftime(day - INTERVAL 26 YEAR, '%Y-%m') FROM observations WHERE job = 'signup') AS gap_logged FROM m)
SELECT *, CAST(NOT listed AS INTEGER) + CAST(NOT billed AS INTEGER) AS open_required FROM s WHERE NOT listed OR NOT billed"""))
def op_bridge_followup(spark: SparkSession, folder: str) -> DataFrame:
    k = F.substr("model_id", F.lit(2)).cast("int")
    owed = L.owed(registry(spark, folder)).select(F.concat(F.lit("model_"), (k % 2 + 1).cast("string")).alias("new_model"), F.concat(F.lit("p"), F.lpad(k.cast("string"), 2, "0")).alias("protocol_id")).distinct()
    rows = history(spark, folder).where("on_curve")
    new = rows.where("model_id <> 'model_0'").select("protocol_id", "series", F.col("model_id").alias("new_model"), F.col("run_date").alias("new_day"))
    now = rows.where("model_id = 'model_0'").select("protocol_id", "series", F.col("run_date").alias("now_day"))
    done = H.having_near(new, now, ["protocol_id", "series"], "new_day", "now_day").select("new_model", "protocol_id").distinct()
    last = new.groupBy("new_model", "protocol_id").agg(F.max("new_day").alias("day"))
    complete = owed.join(done, ["new_model", "protocol_id"], "left_semi").join(last, ["new_model", "protocol_id"]).select("new_model", "protocol_id", F.date_format("day", "yyyy-MM").alias("month"))
    sweeps = observations(spark, folder).where("job = 'signup'").select(F.date_format(F.add_months("day", -26 * 12), "yyyy-MM").alias("month"))
    generations = spark.createDataFrame([("model_0",), ("model_1",)], "new_model string")
    return L.bridge_steps(complete, generations, ledger(spark, folder), sweeps)


@query(with_views("protocols ledger", reading._CURRENT + f""", y AS (SELECT rewording_type AS t, arg_min(n, (protocol_id, place)) AS n FROM c GROUP BY rewording_type), pl AS (SELECT CAST(sum(n) * 8 AS BIGINT) AS calls_total FROM y),
m AS (SELECT coalesce(sum(cents) FILTER (WHERE category = 'bridge'), 0) AS cents FROM ledger WHERE strftime(run_date, '%Y-%m') = (SELECT strftime(max(run_date), '%Y-%m') FROM ledger)),
d AS (SELECT family, count(*) AS n_events, min(CASE WHEN change = 'appeared' THEN model_id END) AS new_model FROM ({tracking.SQL['op_model_diff']}) z GROUP BY family)
SELECT family, n_events, new_model, CASE WHEN new_model IS NOT NULL THEN calls_total END AS calls_total, CASE WHEN new_model IS NOT NULL THEN CAST(calls_total * 66 AS DOUBLE) / 10000 END AS cost,
  CASE WHEN new_model IS NOT NULL THEN cents * 100 + calls_total * 66 <= length(family) * 15000000 END AS allowed FROM d, pl, m"""))
def op_listing_check(spark: SparkSession, folder: str) -> DataFrame:
    """What a changed listing asks for: events, the plan of a bridge, and whether the reserve allows it."""
    spends = ledger(spark, folder)
    month = F.date_format("run_date", "yyyy-MM")
    last = spends.agg(F.max(month)).first()[0]
    spent = spends.where((F.col("category") == "bridge") & (month == F.lit(last))).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("spent"))
    diff = tracking.op_model_diff(spark, folder)
    reserves = diff.select("family").distinct().select("family", (F.length("family") * 1500).cast("decimal(20,2)").alias("reserve"))
    found = L.listing_verdicts(diff, P.plan_bridge(protocols(spark, folder)), spent, reserves, COST_PER_CALL_EUR)
    return found.withColumn("cost", F.col("cost").cast("double"))
