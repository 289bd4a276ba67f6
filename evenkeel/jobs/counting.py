"""Queries over trials: counts, distances, scenarios, gates. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import counts, gates, scenarios
from evenkeel.sources.derived import panels, trials, with_views
from evenkeel.sources.tables import materialize

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _per(by: str, name: str) -> str:
    """A CTE of conditional counts, one row for each group."""
    parts = []
    for v in ("A", "A_prime", "B", "C"):
        parts.append(f"count(*) FILTER (WHERE version = '{v}') AS n_{v}, count(*) FILTER (WHERE version = '{v}' AND outcome = 'valid') AS v_{v}")
        parts += [f"count(*) FILTER (WHERE version = '{v}' AND outcome = 'valid' AND token = '{o}') AS {o}_{v}" for o in "AB"]
    return f", {name} AS (SELECT {by}, {', '.join(parts)} FROM trials GROUP BY {by})"


def _gap(x: str, y: str) -> str:
    """Exact numerator of the distance; its denominator is 2 * v_x * v_y."""
    return f"(abs(A_{x}::HUGEINT * v_{y} - A_{y}::HUGEINT * v_{x}) + abs(B_{x}::HUGEINT * v_{y} - B_{y}::HUGEINT * v_{x}))"


def _pub(num: str, den: str) -> str:
    """Half-even at six places of an exact quotient."""
    s = f"(({num})::HUGEINT * 1000000)"
    d = f"nullif(({den})::HUGEINT, 0)"
    return f"(({s} // {d} + CASE WHEN 2 * ({s} % {d}) > {d} OR (2 * ({s} % {d}) = {d} AND ({s} // {d}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 1e6)"


def _pct(x: str, y: str) -> str:
    return f"CASE WHEN v_{x} > 0 AND v_{y} > 0 THEN {_pub(f'100 * {_gap(x, y)}', f'2 * v_{x}::HUGEINT * v_{y}')} END"


def _loss(x: str, y: str, sign: str) -> str:
    a, b = f"(n_{x} - v_{x})::HUGEINT * n_{y}", f"(n_{y} - v_{y})::HUGEINT * n_{x}"
    return f"abs({a} {sign} {b})"


_STABLE = f"CASE WHEN v_A > 0 AND v_B > 0 THEN {_pub(f'100 * (2 * v_A::HUGEINT * v_B - {_gap(chr(65), chr(66))})', '2 * v_A::HUGEINT * v_B')} END"
_PAIRS = (("ab", "A", "B"), ("aa", "A", "A_prime"), ("ac", "A", "C"))


@query(with_views("trials", _per("run_id", "c") + " SELECT run_id, " + ", ".join(f"{_pct(x, y)} AS gap_pct_{p}" for p, x, y in _PAIRS) + f", {_STABLE} AS stability_pct FROM c"))
def op_tvd_stability(spark: SparkSession, folder: str) -> DataFrame:
    return counts.tvd_stability(trials(spark, folder))


@query(with_views("trials", """, o AS (SELECT unnest(['A', 'B']) AS option), v AS (SELECT unnest(['A', 'A_prime', 'B', 'C']) AS version), r AS (SELECT DISTINCT run_id FROM trials)
SELECT r.run_id, v.version, o.option, count(t.token) AS n FROM r CROSS JOIN v CROSS JOIN o
LEFT JOIN trials t ON t.run_id = r.run_id AND t.version = v.version AND t.token = o.option AND t.outcome = 'valid' GROUP BY ALL"""))
def op_option_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.option_counts(trials(spark, folder))


@query(with_views("trials", _per("run_id", "c") + " SELECT run_id, " + ", ".join(f"{_pub(f'n_{v} - v_{v}', f'n_{v}')} AS u_{v.lower()}" for v in ("A", "A_prime", "B", "C")) + ", "
       + ", ".join(f"{_pub('100 * ' + _loss(x, y, s), f'n_{x}::HUGEINT * n_{y}')} AS {name}_{p}" for s, name in (("+", "drop_bound_pct"), ("-", "drop_asymmetry_pct")) for p, x, y in _PAIRS) + " FROM c"))
def op_loss_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return counts.loss_bounds(trials(spark, folder))


def _h(v: str) -> str:
    part = lambda o: f"CASE WHEN {o}_{v} > 0 THEN {o}_{v} / v_{v}::DOUBLE * ln({o}_{v} / v_{v}::DOUBLE) ELSE 0 END"
    return f"CASE WHEN v_{v} > 0 THEN -({part('A')} + {part('B')}) / ln(2.0) END"


@query(with_views("trials", _per("run_id", "c") + " SELECT run_id, " + ", ".join(f"round({_h(v)}, 6) AS entropy_{v.lower()}" for v in ("A", "A_prime", "B", "C")) + " FROM c"))
def op_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return counts.entropies(trials(spark, folder))


_OUTCOMES = ("valid", "unparseable", "refused", "blocked_upstream", "truncated", "empty", "off_format")


@query(with_views("trials", " SELECT run_id, version, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in _OUTCOMES) + " FROM trials GROUP BY ALL"))
def op_outcome_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return counts.outcome_histogram(trials(spark, folder))


@query(with_views("trials", f""", o AS (SELECT unnest({list(_OUTCOMES)}) AS outcome), g AS (SELECT DISTINCT run_id, version FROM trials)
SELECT g.run_id, g.version, o.outcome, count(t.place) AS count FROM g CROSS JOIN o LEFT JOIN trials t ON t.run_id = g.run_id AND t.version = g.version AND t.outcome = o.outcome GROUP BY ALL"""))
def op_outcome_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    return counts.outcome_rows(trials(spark, folder))


@query(with_views("trials", f" SELECT run_id, version, {_pub(chr(40) + 'count(*) FILTER (WHERE outcome = ' + repr('valid') + '))', 'count(*)')} AS valid_share FROM trials GROUP BY ALL"))
def op_valid_share(spark: SparkSession, folder: str) -> DataFrame:
    return counts.valid_share(trials(spark, folder))


@query(with_views("trials", " SELECT run_id, version, count(*) FILTER (WHERE token = 'A') AS decided_a, count(*) FILTER (WHERE token = 'B') AS decided_b FROM trials WHERE outcome = 'valid' GROUP BY ALL"))
def op_decision_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return counts.decision_table(trials(spark, folder))


@query(with_views("trials", " SELECT outcome, count(*) AS lost, count(DISTINCT run_id) AS runs FROM trials WHERE outcome <> 'valid' GROUP BY outcome"))
def op_lost_replies(spark: SparkSession, folder: str) -> DataFrame:
    return counts.lost_replies(trials(spark, folder))


@query(with_views("trials", _per("run_id, scenario_id", "c") + """, m AS (SELECT run_id, CASE WHEN A_A > B_A THEN 1 WHEN B_A > A_A THEN 2 END AS a, CASE WHEN A_B > B_B THEN 1 WHEN B_B > A_B THEN 2 END AS b FROM c)
SELECT run_id, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS measurable, count(*) FILTER (WHERE a <> b) AS changed FROM m GROUP BY run_id"""))
def op_changed_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return counts.changed_decisions(trials(spark, folder))


@query(with_views("trials", " SELECT run_id, version, string_agg(DISTINCT token, ',' ORDER BY token) AS tokens FROM trials GROUP BY ALL"))
def op_tokens_seen(spark: SparkSession, folder: str) -> DataFrame:
    return counts.tokens_seen(trials(spark, folder))


_GAPS = _per("run_id, scenario_id", "c") + f""", g AS (SELECT r.run_id, s.scenario_id, {_pct('A', 'B')} AS gap_pct FROM (SELECT DISTINCT run_id FROM trials) r CROSS JOIN (SELECT 's' || lpad(CAST(unnest(range(1, 16)) AS VARCHAR), 2, '0') AS scenario_id) s
  LEFT JOIN c ON c.run_id = r.run_id AND c.scenario_id = s.scenario_id)"""


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    return scenarios.gaps(trials(spark, folder), panels(spark, folder))


@query(with_views("trials", _GAPS + " SELECT * FROM g"))
def op_scenario_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _gaps(spark, folder)


@query(with_views("trials", _GAPS + """, q AS (SELECT run_id, count(*) AS known, min(gap_pct) AS min_pct, quantile_disc(gap_pct, 0.25) AS q1_pct, round(median(gap_pct), 6) AS median_pct,
  quantile_disc(gap_pct, 0.75) AS q3_pct, max(gap_pct) AS max_pct FROM g WHERE gap_pct IS NOT NULL GROUP BY run_id) SELECT *, round(q3_pct - q1_pct, 6) AS iqr_pct FROM q"""))
def op_scenario_spread(spark: SparkSession, folder: str) -> DataFrame:
    return scenarios.spread(_gaps(spark, folder))


_CONCENTRATION = """, k AS (SELECT run_id, gap_pct, row_number() OVER (PARTITION BY run_id ORDER BY gap_pct DESC NULLS LAST, scenario_id) AS place FROM g),
  z AS (SELECT run_id, round(100 * sum(CASE WHEN place <= 2 THEN gap_pct END) / nullif(sum(gap_pct), 0), 5) AS concentration_pct FROM k GROUP BY run_id)"""


@query(with_views("trials", _GAPS + _CONCENTRATION + " SELECT * FROM z"))
def op_scenario_concentration(spark: SparkSession, folder: str) -> DataFrame:
    return scenarios.concentration(_gaps(spark, folder))


@query(with_views("trials", _GAPS + " SELECT run_id, scenario_id, gap_pct, CAST(row_number() OVER (PARTITION BY run_id ORDER BY gap_pct DESC NULLS LAST, scenario_id) AS INTEGER) AS place FROM g"))
def op_scenario_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return scenarios.ranked(_gaps(spark, folder))


def gated(spark: SparkSession, folder: str) -> DataFrame:
    """Every run with its gates; thresholds, status and lane follow the run's number."""
    # the trials are counted once, by run and scenario; the rest works on these few rows
    cells = materialize(counts.tally(trials(spark, folder), ["run_id", "scenario_id"]), "cells")
    rows = counts.with_pairs(counts.added(cells, ["run_id"])).join(scenarios.concentration(scenarios.cell_gaps(cells)), "run_id", "left")
    k = F.substr("run_id", F.lit(5)).cast("int")
    theta = F.when(k % 5 != 0, (10 + k).cast("decimal(12,6)"))
    share = F.when(k % 7 != 0, (15 + 3 * k).cast("decimal(12,6)"))
    judged = gates.gates(rows, theta, share, F.col("concentration_pct"), 1 + k % 2)
    status, lane = F.when(k % 6 == 4, "candidate").otherwise("admitted"), F.element_at(F.array(F.lit("open"), F.lit("guard"), F.lit("sealed")), 1 + k % 3)
    kind = F.element_at(F.array(*map(F.lit, ("wording", "order", "default", "anchoring"))), 1 + k % 4)
    return judged.withColumns({"status": status, "lane": lane, "rewording_type": kind, "series": F.when(k % 2 == 0, "commercial").otherwise("open_weights")}).withColumn("on_curve", gates.on_curve(F.col("status"), F.col("lane")))


def _net(sign: str, p: str) -> str:
    x, y = {"ab": ("A", "B"), "aa": ("A", "A_prime"), "ac": ("A", "C")}[p]
    return f"({_gap(x, y)} * (n_{x}::HUGEINT * n_{y}) {sign} {_loss(x, y, '+')} * (2 * v_{x}::HUGEINT * v_{y}))"


_SOME = {p: f"(v_{x} > 0 AND v_{y} > 0)" for p, x, y in _PAIRS}
_GATED = _GAPS + _CONCENTRATION + _per("run_id", "w") + f""", t AS (SELECT w.*, z.concentration_pct, CAST(substr(w.run_id, 5) AS INTEGER) AS k FROM w LEFT JOIN z USING (run_id)),
u AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 10 + k END AS theta, CASE WHEN k % 7 <> 0 THEN 15 + 3 * k END AS share, 1 + k % 2 AS grammar,
  CASE WHEN k % 6 = 4 THEN 'candidate' ELSE 'admitted' END AS status, ['open', 'guard', 'sealed'][1 + k % 3] AS lane, ['wording', 'order', 'default', 'anchoring'][1 + k % 4] AS rewording_type,
  CASE WHEN k % 2 = 0 THEN 'commercial' ELSE 'open_weights' END AS series FROM t),
x AS (SELECT *, CASE WHEN theta IS NOT NULL THEN coalesce({_SOME['ac']} AND 100 * {_net('-', 'ac')} > (2 * v_A::HUGEINT * v_C) * (n_A::HUGEINT * n_C) * theta, false) END AS reading,
  {_SOME['ab']} AND {_net('-', 'ab')} > 0 AS above_drop_bound,
  {_SOME['ab']} AND {_SOME['aa']} AND {_net('-', 'ab')} * (n_A_prime::HUGEINT * v_A_prime) > {_net('+', 'aa')} * (n_B::HUGEINT * v_B) AS above_surface_noise,
  CASE WHEN share IS NOT NULL THEN coalesce(concentration_pct > share, false) END AS dominated,
  {' OR '.join(f"100 * {_loss(a, b, '+')} > 2 * n_{a}::HUGEINT * n_{b}" for _, a, b in _PAIRS)} AS f1,
  {' OR '.join(f"100 * {_loss(a, b, '-')} > n_{a}::HUGEINT * n_{b}" for _, a, b in _PAIRS)} AS f2,
  {_SOME['ab']} AND greatest({_h('A')}, {_h('B')}) < 0.2 AND 100 * (2 * v_A::HUGEINT * v_B - {_gap('A', 'B')}) > 90 * 2 * v_A::HUGEINT * v_B AS steady FROM u),
y AS (SELECT *, list_filter([CASE WHEN f1 THEN 'drop_confounded' END, CASE WHEN f2 THEN 'asymmetric_missingness' END, CASE WHEN NOT above_drop_bound THEN 'below_drop_bound' END,
  CASE WHEN NOT above_surface_noise THEN 'below_surface_noise' END, CASE WHEN NOT reading THEN 'not_reading' END,
  CASE WHEN steady AND NOT (grammar >= 2 AND coalesce(reading, false)) THEN 'degenerate_candidate' END, CASE WHEN dominated THEN 'scenario_dominated' END], lambda q: q IS NOT NULL) AS flags FROM x),
e AS (SELECT *, len(flags) = 0 AND theta IS NOT NULL AND share IS NOT NULL AS all_passed FROM y)"""


@query(with_views("trials", _GATED + """ SELECT run_id, reading, above_drop_bound, above_surface_noise, dominated, array_to_string(flags, ',') AS flags,
  concat_ws(',', CASE WHEN theta IS NULL THEN 'theta_positive_pct' END, CASE WHEN share IS NULL THEN 'scenario_dominated_share_pct' END) AS unset, all_passed,
  all_passed AND status = 'admitted' AND lane IN ('open', 'guard') AS on_curve FROM e"""))
def op_gates_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = gated(spark, folder)
    return rows.select("run_id", "reading", "above_drop_bound", "above_surface_noise", "dominated", F.array_join("flags", ",").alias("flags"), F.array_join("unset", ",").alias("unset"), "all_passed", "on_curve")


@query(with_views("trials", _GATED + " SELECT flag, count(*) AS runs FROM (SELECT unnest(flags) AS flag FROM e) GROUP BY flag"))
def op_flag_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return gated(spark, folder).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("runs"))


@query(with_views("trials", _GATED + " SELECT series, lane, rewording_type, count(*) AS runs, count(*) FILTER (WHERE all_passed AND status = 'admitted' AND lane IN ('open', 'guard')) AS on_curve, count(*) FILTER (WHERE reading) AS reading FROM e WHERE status = 'admitted' GROUP BY ALL"))
def op_headline(spark: SparkSession, folder: str) -> DataFrame:
    rows = gated(spark, folder).where("status = 'admitted'")
    return rows.groupBy("series", "lane", "rewording_type").agg(F.count("*").alias("runs"), F.count_if("on_curve").alias("on_curve"), F.count_if("reading").alias("reading"))
