"""Queries over measurement histories and logs. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import history as H
from evenkeel.operators import logs as L
from evenkeel.sources.derived import history, ledger, observations, protocols, registry, with_views
from evenkeel.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_LATEST = ", l AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY protocol_id, series, model_id ORDER BY run_date DESC, run_id DESC) AS r FROM history) WHERE r = 1)"
_VERDICT = """CASE WHEN abs(y_s - x_s) >= sqrt(((x_h - x_l) / 2) * ((x_h - x_l) / 2) + ((y_h - y_l) / 2) * ((y_h - y_l) / 2)) AND abs(y_s - x_s) > x_b + y_b
  THEN CASE WHEN y_s - x_s > 0 THEN 'improved' ELSE 'regressed' END WHEN y_s IS NOT NULL AND x_s IS NOT NULL THEN 'flat' END"""


@query(with_views("history", _LATEST + " SELECT * FROM l"))
def op_latest(spark: SparkSession, folder: str) -> DataFrame:
    return H.latest(history(spark, folder))


@query(with_views("history", " SELECT protocol_id, series, model_id, run_id, run_date, CAST(row_number() OVER (w ORDER BY run_date, run_id) AS INTEGER) AS place, count(*) OVER (w) AS of FROM history WINDOW w AS (PARTITION BY protocol_id, series, model_id)"))
def op_history(spark: SparkSession, folder: str) -> DataFrame:
    return H.numbered(history(spark, folder))


@query(with_views("history", f""", t AS (SELECT protocol_id, series, model_id, run_id, stability_pct AS y_s, ci_low_pct AS y_l, ci_high_pct AS y_h, bound_pct AS y_b,
  lag(stability_pct) OVER w AS x_s, lag(ci_low_pct) OVER w AS x_l, lag(ci_high_pct) OVER w AS x_h, lag(bound_pct) OVER w AS x_b FROM history WINDOW w AS (PARTITION BY protocol_id, series, model_id ORDER BY run_date, run_id))
SELECT protocol_id, series, model_id, run_id, CASE WHEN x_s IS NULL OR y_s IS NULL THEN 'base' ELSE {_VERDICT} END AS trend, y_s - x_s AS delta FROM t"""))
def op_trend(spark: SparkSession, folder: str) -> DataFrame:
    return H.trend(history(spark, folder))


_NEAR = """, p AS (SELECT a.protocol_id, a.series, a.model_id AS this_model, b.model_id AS other_model, a.run_id AS this_run, b.run_id AS other_run, abs(date_diff('day', a.run_date, b.run_date)) AS gap, a.run_date AS d,
  a.stability_pct AS y_s, a.ci_low_pct AS y_l, a.ci_high_pct AS y_h, a.bound_pct AS y_b, b.stability_pct AS x_s, b.ci_low_pct AS x_l, b.ci_high_pct AS x_h, b.bound_pct AS x_b
  FROM history a JOIN history b ON a.protocol_id = b.protocol_id AND a.series = b.series AND a.model_id <> b.model_id AND abs(date_diff('day', a.run_date, b.run_date)) <= 7)"""


@query(with_views("history", _NEAR + f", r AS (SELECT *, row_number() OVER (PARTITION BY protocol_id, series, this_model, other_model ORDER BY gap, d DESC, this_run, other_run) AS n FROM p) SELECT protocol_id, series, this_model, other_model, this_run, other_run, CAST(gap AS INTEGER) AS gap, {_VERDICT} AS verdict FROM r WHERE n = 1"))
def op_bridge_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return H.bridges(history(spark, folder))


@query(with_views("history", _NEAR + " SELECT series, this_model, other_model, CAST(gap AS INTEGER) AS gap, count(*) AS pairs FROM p GROUP BY ALL"))
def op_near_measurements(spark: SparkSession, folder: str) -> DataFrame:
    return H.model_pairs(history(spark, folder)).groupBy("series", "this_model", "other_model", "gap").agg(F.count("*").alias("pairs"))


@query(with_views("history", _LATEST + _NEAR + f""", r AS (SELECT *, {_VERDICT} AS verdict, row_number() OVER (PARTITION BY protocol_id, series, this_model, other_model ORDER BY gap, d DESC, this_run, other_run) AS n FROM p)
SELECT a.protocol_id, a.series, a.model_id, a.run_id, b.model_id AS other_model, b.run_id AS other_run, CAST(abs(date_diff('day', a.run_date, b.run_date)) AS INTEGER) AS days_apart, r.this_run AS bridge_this, r.other_run AS bridge_other, r.verdict
FROM l a JOIN l b ON a.protocol_id = b.protocol_id AND a.series = b.series AND a.model_id <> b.model_id
LEFT JOIN r ON r.n = 1 AND r.protocol_id = a.protocol_id AND r.series = a.series AND r.this_model = a.model_id AND r.other_model = b.model_id"""))
def op_other_models(spark: SparkSession, folder: str) -> DataFrame:
    rows = history(spark, folder)
    pairs = H.bridges(rows).select("protocol_id", "series", F.col("this_model").alias("model_id"), "other_model", F.col("this_run").alias("bridge_this"), F.col("other_run").alias("bridge_other"), "verdict")
    return H.other_models(rows).join(pairs, ["protocol_id", "series", "model_id", "other_model"], "left")


_SUCCESSOR = "'p' || lpad(CAST((CAST(substr(protocol_id, 2) AS INTEGER) + 1) % 97 AS VARCHAR), 2, '0')"


def _successor() -> F.Column:
    return F.concat(F.lit("p"), F.lpad(((F.substr("protocol_id", F.lit(2)).cast("int") + 1) % 97).cast("string"), 2, "0"))


@query(with_views("history", f" SELECT o.protocol_id AS old_protocol, o.model_id, count(*) AS pairs, CAST(min(abs(date_diff('day', o.run_date, n.run_date))) AS INTEGER) AS closest FROM (SELECT *, {_SUCCESSOR} AS successor FROM history) o JOIN history n ON n.protocol_id = o.successor AND n.model_id = o.model_id AND abs(date_diff('day', o.run_date, n.run_date)) <= 7 GROUP BY ALL"))
def op_bridge_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = history(spark, folder)
    pairs = H.panel_bridges(rows.withColumn("successor", _successor()), rows)
    return pairs.groupBy("old_protocol", "model_id").agg(F.count("*").alias("pairs"), F.min(F.abs(F.datediff("old_day", "new_day"))).alias("closest"))


@query(with_views("history", _LATEST + f""", z AS (SELECT a.protocol_id, a.series, a.model_id, a.run_date AS da, b.run_date AS db, a.stability_pct AS x_s, a.ci_low_pct AS x_l, a.ci_high_pct AS x_h, a.bound_pct AS x_b,
  b.stability_pct AS y_s, b.ci_low_pct AS y_l, b.ci_high_pct AS y_h, b.bound_pct AS y_b FROM (SELECT *, {_SUCCESSOR} AS successor FROM l) a JOIN l b ON b.protocol_id = a.successor AND b.series = a.series AND b.model_id = a.model_id),
v AS (SELECT *, {_VERDICT} AS verdict FROM z) SELECT protocol_id, series, model_id, CASE WHEN verdict = 'flat' THEN 'flat' WHEN verdict IS NOT NULL THEN 'differs' END AS result, round(y_s - x_s, 1) AS delta,
  CAST(abs(date_diff('day', da, db)) AS INTEGER) AS days_apart, abs(date_diff('day', da, db)) <= 7 AS in_window FROM v"""))
def op_panel_compare(spark: SparkSession, folder: str) -> DataFrame:
    now = H.latest(history(spark, folder))
    x = now.select(*H.LINE, _successor().alias("successor"), F.struct(*H.FIGURES).alias("x"), F.col("run_date").alias("day_x"))
    y = now.select(F.col("protocol_id").alias("successor"), "series", "model_id", F.struct(*H.FIGURES).alias("y"), F.col("run_date").alias("day_y"))
    rows = H.panel_compare(x.join(y, ["successor", "series", "model_id"]), "x", "y", "day_x", "day_y")
    return rows.select(*H.LINE, "result", "delta", "days_apart", "in_window")


_KNOWN = ", k AS (SELECT family, model_id FROM (SELECT family, model_id, arg_max(event, place) AS e FROM registry WHERE event IN ('baseline', 'appeared', 'gone') GROUP BY ALL) WHERE e <> 'gone')"


@query(with_views("registry", _KNOWN + " SELECT * FROM k"))
def op_registry_state(spark: SparkSession, folder: str) -> DataFrame:
    return L.listed_models(registry(spark, folder))


@query(with_views("registry", _KNOWN.replace("registry", "old") .replace(", k AS", ", old AS (SELECT * FROM registry WHERE family <> 'signup'), k AS") + """, g AS (SELECT DISTINCT event_type AS family, 'm' || ((user_id * 7) % 71) AS model_id FROM events),
a AS (SELECT DISTINCT event_type AS family, 'm' || (event_id % 9) AS model_id FROM events),
b AS (SELECT coalesce(g.family, k.family) AS family, coalesce(g.model_id, k.model_id) AS model_id, g.family IS NOT NULL AS listed, k.family IS NOT NULL AS seen FROM g FULL JOIN k ON g.family = k.family AND g.model_id = k.model_id),
c AS (SELECT b.*, CASE WHEN listed AND family NOT IN (SELECT family FROM old) THEN 'baseline' WHEN listed AND NOT seen THEN 'appeared' WHEN seen AND NOT listed THEN 'gone' END AS change FROM b)
SELECT c.family, c.model_id, c.change, a.family IS NOT NULL AND c.change = 'gone' AS active_gone FROM c LEFT JOIN a ON a.family = c.family AND a.model_id = c.model_id WHERE change IS NOT NULL"""))
def op_model_diff(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    listing = e.select(F.col("event_type").alias("family"), F.concat(F.lit("m"), (F.col("user_id") * 7 % 71).cast("string")).alias("model_id"))
    active = e.select(F.col("event_type").alias("family"), F.concat(F.lit("m"), (F.col("event_id") % 9).cast("string")).alias("model_id"))
    return L.model_diff(listing, registry(spark, folder).where("family <> 'signup'"), active)


@query(with_views("registry", """, w AS (SELECT DISTINCT family, model_id FROM registry WHERE event = 'bridge_waived'), z AS (SELECT family, model_id, arg_max(event, place) AS e, arg_max(day, place) AS since FROM registry WHERE event IN ('baseline', 'appeared', 'gone') GROUP BY ALL)
SELECT family, model_id, since FROM z WHERE e = 'appeared' AND NOT EXISTS (SELECT 1 FROM w WHERE w.family = z.family AND w.model_id = z.model_id)"""))
def op_bridges_owed(spark: SparkSession, folder: str) -> DataFrame:
    return L.owed(registry(spark, folder))


@query(with_views("observations", " SELECT day, count(*) FILTER (WHERE ran) AS ran, count(*) AS of FROM observations GROUP BY day"))
def op_daily_checks(spark: SparkSession, folder: str) -> DataFrame:
    return L.daily(observations(spark, folder))


@query(with_views("observations", " SELECT cause, count(*) AS gaps FROM observations WHERE NOT ran GROUP BY cause"))
def op_coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    return L.missing_causes(observations(spark, folder))


@query(with_views("observations", """, s AS (SELECT CASE WHEN job IN ('click', 'view') THEN 'full_sweep' ELSE 'reference' END AS runner, day, cause AS reason FROM observations WHERE NOT ran)
SELECT runner, day, count(DISTINCT reason) AS reasons, CASE WHEN count(DISTINCT reason) = 1 AND runner = 'full_sweep' AND min(reason) = 'budget_halted' THEN 'budget_halted' END AS cause FROM s GROUP BY runner, day"""))
def op_gap_causes(spark: SparkSession, folder: str) -> DataFrame:
    rows = observations(spark, folder).where("not ran")
    return L.honest_causes(rows.select(F.when(F.col("job").isin("click", "view"), "full_sweep").otherwise("reference").alias("runner"), "day", F.col("cause").alias("reason")))


@query(with_views("history observations", """, f AS (SELECT run_date AS day, 2 AS o, 'measured' AS kind, protocol_id || ' · ' || model_id AS what, format('stability {:.1f}%', stability_pct) AS result, CASE WHEN on_curve THEN 'on' ELSE 'off' END AS tone FROM history WHERE stability_pct IS NOT NULL
UNION ALL SELECT day, 1, 'checks', 'scheduled checks', count(*) FILTER (WHERE ran) || ' of ' || count(*) || ' ran', NULL FROM observations GROUP BY day HAVING count(*) FILTER (WHERE ran) > 0
UNION ALL SELECT day, 1, 'gap', job, 'cause: ' || cause, 'gap' FROM observations WHERE NOT ran) SELECT day, kind, what, result, tone FROM f ORDER BY day DESC, o DESC, what DESC, result DESC, tone DESC NULLS LAST LIMIT 30"""))
def op_recent_activity(spark: SparkSession, folder: str) -> DataFrame:
    return L.activity(history(spark, folder).where("stability_pct is not null"), observations(spark, folder))


_TODAY = "(SELECT max(day) FROM observations)"


@query(with_views("observations", f""", i AS (SELECT job, CAST(1 + length(job) % 4 AS DOUBLE) / 2 AS interval_days FROM (SELECT DISTINCT job FROM observations) UNION ALL SELECT 'quarterly', 90.0),
z AS (SELECT job, max(day) AS last_run FROM observations WHERE ran GROUP BY job)
SELECT i.job, i.interval_days, z.last_run, CAST(date_diff('day', z.last_run, {_TODAY}) AS DOUBLE) AS elapsed_days, z.last_run IS NULL OR date_diff('day', z.last_run, {_TODAY}) >= i.interval_days AS due FROM i LEFT JOIN z ON z.job = i.job"""))
def op_due_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return L.due(*_cadence(spark, folder)).withColumn("elapsed_days", F.col("elapsed_days").cast("double"))


def _cadence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, F.Column]:
    rows = observations(spark, folder)
    jobs = rows.select("job").distinct().select("job", ((1 + F.length("job") % 4).cast("double") / 2).alias("interval_days"))
    extra = spark.range(1).select(F.lit("quarterly").alias("job"), F.lit(90.0).alias("interval_days"))
    today = F.lit(rows.agg(F.max("day")).first()[0])
    return jobs.unionByName(extra), L.latest_state(rows), today


@query(with_views("observations", f""", i AS (SELECT job, CAST(1 + length(job) % 4 AS DOUBLE) / 2 AS interval_days FROM (SELECT DISTINCT job FROM observations) UNION ALL SELECT 'quarterly', 90.0),
z AS (SELECT job, max(day) AS last_run FROM observations WHERE ran GROUP BY job), d AS (SELECT i.job FROM i LEFT JOIN z ON z.job = i.job WHERE z.last_run IS NULL OR date_diff('day', z.last_run, {_TODAY}) + 1 >= i.interval_days),
r AS (SELECT DISTINCT job, CASE WHEN length(job) > 5 THEN 'sweep' ELSE 'reference' END AS runner FROM i) SELECT runner, string_agg(DISTINCT job, ',' ORDER BY job) AS jobs FROM d JOIN r USING (job) GROUP BY runner"""))
def op_route_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs due on the day after the log's last."""
    jobs, states, today = _cadence(spark, folder)
    runners = jobs.select("job", F.when(F.length("job") > 5, "sweep").otherwise("reference").alias("runner"))
    return L.routed(L.due(jobs, states, F.date_add(today, 1)), runners)


@query(with_views("ledger", """ SELECT strftime(run_date, '%Y-%m') AS month, count(*) AS entries, count(*) FILTER (WHERE contains(note, 'not yet reconciled')) AS auto_entries,
  CAST(sum(cents) AS DOUBLE) / 100 AS total, CAST(coalesce(sum(cents) FILTER (WHERE contains(note, 'not yet reconciled')), 0) AS DOUBLE) / 100 AS auto_total FROM ledger GROUP BY ALL"""))
def op_month_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return L.month_ledger(ledger(spark, folder)).withColumns({c: F.col(c).cast("double") for c in ("total", "auto_total")})


@query(with_views("ledger", """, m AS (SELECT strftime(run_date, '%Y-%m') AS month, category, sum(cents) AS cents FROM ledger GROUP BY ALL), c AS (SELECT category, max(cents) AS ceiling FROM m GROUP BY category)
SELECT month, category, CASE WHEN cents * 100 >= ceiling * 95 THEN 'fingerprint_only' WHEN cents * 100 >= ceiling * 80 THEN 'guard_only_sweep' WHEN cents * 100 >= ceiling * 60 THEN 'reduced_sweep' ELSE 'full' END AS rung,
  strftime(CAST(month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS previous_month FROM m JOIN c USING (category)"""))
def op_budget_rung(spark: SparkSession, folder: str) -> DataFrame:
    m = ledger(spark, folder).groupBy(F.date_format("run_date", "yyyy-MM").alias("month"), "category").agg(F.sum("amount").alias("spent"))
    rows = m.join(m.groupBy("category").agg(F.max("spent").alias("ceiling")), "category")
    before = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1), "yyyy-MM")
    return rows.select("month", "category", L.rung(F.col("spent"), F.col("ceiling"))["name"].alias("rung"), before.alias("previous_month"))


@query(""" WITH c AS (SELECT event_type, event_id, user_id % 25 AS client, value < 25 AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY client ORDER BY event_id) AS good FROM c)
SELECT client, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g WHERE failed GROUP BY client, good HAVING count(*) >= 5""")
def op_error_runs(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "events").select("event_id", (F.col("user_id") % 25).alias("client"), (F.col("value") < 25).alias("failed"))
    return L.error_runs(calls, ["client"], "event_id")


_FATAL = """ WITH c AS (SELECT user_id, event_id, value < 25 AS failed, CASE WHEN value < 25 THEN ([500, 429, 401, 500, 404, 400, 529])[event_id % 7 + 1] END AS status, CASE WHEN event_id % 2 = 0 THEN 'Your credit balance is too low' ELSE 'overloaded' END AS message FROM events),
g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS good FROM c),
s AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY user_id, good ORDER BY event_id) AS streak FROM g),
w AS (SELECT *, CASE WHEN NOT failed THEN NULL WHEN status IN (400, 402, 403, 429) AND contains(lower(message), 'credit balance is too low') THEN 'funds' WHEN status IN (401, 403, 404) THEN 'status' WHEN streak >= 5 THEN 'failures' END AS why FROM s)
SELECT user_id, min(event_id) AS stopped_at, arg_min(why, event_id) AS why FROM w WHERE why IS NOT NULL GROUP BY user_id"""


@query(_FATAL)
def op_run_stops(spark: SparkSession, folder: str) -> DataFrame:
    failed, k = F.col("value") < 25, F.col("event_id")
    status = F.when(failed, F.element_at(F.array(*map(F.lit, (500, 429, 401, 500, 404, 400, 529))), (k % 7 + 1).cast("int")))
    message = F.when(k % 2 == 0, "Your credit balance is too low").otherwise("overloaded")
    calls = table(spark, folder, "events").select("user_id", "event_id", failed.alias("failed"), status.alias("status"), message.alias("message"))
    return L.run_stops(calls, ["user_id"], "event_id")


@query(with_views("observations", f" SELECT DISTINCT day AS run_date FROM observations WHERE NOT ran AND day BETWEEN {_TODAY} - 6 AND {_TODAY}"))
def op_alarms_since(spark: SparkSession, folder: str) -> DataFrame:
    rows = observations(spark, folder)
    today = F.lit(rows.agg(F.max("day")).first()[0])
    return L.alarms_since(rows.select(F.col("ran").alias("ok"), F.col("day").alias("run_date")), today, 7)


@query(""" WITH n AS (SELECT max(ts) AS now FROM events), z AS (SELECT user_id, (epoch_ms((SELECT now FROM n)) // 1000 - epoch_ms(max(ts)) // 1000)::DOUBLE / 3600 AS silent FROM events GROUP BY user_id)
SELECT user_id, round(silent, 1) AS silent_hours, silent <= 36 AS alive FROM z""")
def op_liveness(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "ts")
    return L.liveness(e, "user_id", F.lit(e.agg(F.max("ts")).first()[0]), 36)


@query(""" SELECT CAST(ts AS DATE) AS day, event_type, event_id AS place, value, first_value(value) OVER (PARTITION BY event_type, user_id ORDER BY CAST(ts AS DATE), event_id) AS baseline, user_id FROM events""")
def op_baselines(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.to_date("ts").alias("day"), "event_type", F.col("event_id").alias("place"), "value", "user_id")
    return L.baselines(e.withColumn("line", F.struct("event_type", "user_id")), "line").drop("line")


@query(with_views("history observations", """, m AS (SELECT DISTINCT strftime(run_date, '%Y-%m') AS month FROM history), r AS (SELECT strftime(run_date, '%Y-%m') AS month, protocol_id, count(*) AS runs FROM history WHERE model_id = 'model_0' GROUP BY ALL)
SELECT protocol_id, count(*) AS months, sum(runs)::BIGINT AS runs, max(month) AS last_month FROM r GROUP BY ALL"""))
def op_monthly_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = history(spark, folder).where("model_id = 'model_0'").groupBy("protocol_id", F.date_format("run_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("runs"))
    return runs.groupBy("protocol_id").agg(F.count("*").alias("months"), F.sum("runs").alias("runs"), F.max("month").alias("last_month"))


def sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """One sweep of the admitted protocols for each series: what a sweep's admission reads."""
    p = protocols(spark, folder).where("status = 'admitted'")
    k = F.col("place")
    return p.select(
        F.concat(F.lit("sweep_"), F.lpad((k % 40).cast("string"), 2, "0")).alias("sweep"),
        "protocol_id",
        "place",
        "lane",
        (k % 7 == 0).alias("already_run"),
        (k % 5 != 0).alias("preregistered"),
        (F.col("n").cast("long") * 4 * 66).alias("cost"),
        (k % 40 * 5000).cast("long").alias("spent"),
        F.lit(400_000).cast("long").alias("ceiling"),
        F.when(k % 11 == 3, "ran_today").when(k % 197 == 5, "no_funds").when(k % 211 == 6, "circuit_open").alias("met"),
        F.when(k % 3 == 0, F.col("n").cast("long") * 4 * 66 - 1000).alias("actual"),
    )


@query(with_views("protocols", """, s AS (SELECT 'sweep_' || lpad(CAST(place % 40 AS VARCHAR), 2, '0') AS sweep, protocol_id, place, lane, place % 7 = 0 AS already_run, place % 5 <> 0 AS preregistered, CAST(n AS BIGINT) * 4 * 66 AS cost, place % 40 * 5000 AS spent, CAST(400000 AS BIGINT) AS ceiling,
  CASE WHEN place % 11 = 3 THEN 'ran_today' WHEN place % 197 = 5 THEN 'no_funds' WHEN place % 211 = 6 THEN 'circuit_open' END AS met, CASE WHEN place % 3 = 0 THEN CAST(n AS BIGINT) * 4 * 66 - 1000 END AS actual FROM protocols WHERE status = 'admitted'),
o AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY protocol_id, place) AS at_row FROM s),
f AS (SELECT DISTINCT sweep AS of, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS ran, CAST(0 AS BIGINT) AS projected, false AS stopped, CAST(NULL AS VARCHAR) AS skipped, CAST(NULL AS VARCHAR) AS rung, false AS funds_exhausted FROM s UNION ALL
  SELECT of, done + 1, ran + CAST(reason IS NULL AS BIGINT), projected + CASE WHEN reason IS NULL THEN coalesce(actual, cost) ELSE 0 END, stopped OR (early IS NULL AND coalesce(met IN ('no_funds', 'circuit_open'), false)), reason, CASE WHEN NOT stopped THEN name END, early IS NULL AND coalesce(met = 'no_funds', false)
  FROM (SELECT *, coalesce(early, CASE met WHEN 'ran_today' THEN 'already_ran_today' WHEN 'no_funds' THEN 'budget_halted' WHEN 'circuit_open' THEN 'circuit_open' END) AS reason
    FROM (SELECT *, CASE WHEN stopped THEN 'not_reached' WHEN already_run THEN 'already_run_this_month' WHEN NOT preregistered THEN 'not_preregistered'
        WHEN ran >= CASE name WHEN 'full' THEN 1000000000 WHEN 'reduced_sweep' THEN 6 WHEN 'guard_only_sweep' THEN 4 ELSE 0 END OR (name = 'guard_only_sweep' AND lane IS DISTINCT FROM 'guard') OR total + cost > ceiling THEN 'budget_halted' END AS early
      FROM (SELECT *, CASE WHEN total * 100 >= ceiling * 95 THEN 'fingerprint_only' WHEN total * 100 >= ceiling * 80 THEN 'guard_only_sweep' WHEN total * 100 >= ceiling * 60 THEN 'reduced_sweep' ELSE 'full' END AS name
        FROM (SELECT f.*, o.*, o.spent + f.projected AS total FROM f JOIN o ON o.sweep = f.of AND o.at_row = f.done + 1)))))
SELECT o.* EXCLUDE (at_row), f.skipped, f.rung, f.funds_exhausted FROM o JOIN f ON f.of = o.sweep AND f.done = o.at_row""").replace("WITH ", "WITH RECURSIVE ", 1))
def op_sweep_admission(spark: SparkSession, folder: str) -> DataFrame:
    return L.admit(sweeps(spark, folder), ["sweep"], ["protocol_id", "place"])
