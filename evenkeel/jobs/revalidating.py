"""The re-derivation audit over a run for each part, every kind of problem planted. Its SQL is beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import hashing as S
from evenkeel.functions.vocabulary import VERSIONS
from evenkeel.operators import counts
from evenkeel.operators import revalidation as V
from evenkeel.sources.tables import materialize, table

QUERIES, SQL = {}, {}

DAY, MODEL, SCENARIOS, REPS = "2026-01-31", "model", 3, 2
#: Replies by the number of a call: text, error, stop_reason.
REPLIES = [("DECISION: A", None, "end_turn"), ("thought\nDecision: B.", None, "end_turn"), (None, "timeout", None), ("no verdict", None, "end_turn"), ("**decision: a**", None, "end_turn"), ("so", None, "refusal"), ("Decision: B", None, "end_turn")]


def declared(spark: SparkSession, folder: str) -> DataFrame:
    """A protocol for each part but one in seven, which has gone."""
    k, name = F.col("p_partkey"), F.col("p_name")
    texts = lambda s: F.struct(*(F.concat(F.lit(f"{v} {s}: "), name).alias(v) for v in VERSIONS))
    scenarios = F.array(*(F.struct(F.lit(f"s{s}").alias("scenario_id"), texts(s).alias("versions")) for s in range(SCENARIOS)))
    return table(spark, folder, "part").where(k % 7 != 1).select(F.concat(F.lit("p"), k.cast("string")).alias("protocol_id"), S.sha256(F.concat(F.lit("protocol"), k.cast("string"))).alias("protocol_sha256"), F.lit("Read {scenario}").alias("prompt_template"), F.lit(REPS).alias("n_per_scenario"), scenarios.alias("scenarios"), F.array(F.lit("A"), F.lit("B")).alias("options"), (1 + k % 2).cast("int").alias("grammar_version"))


def kept_runs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    sha = S.sha256(F.concat(F.when(k % 7 == 2, "other").otherwise("protocol"), k.cast("string")))
    return table(spark, folder, "part").select(k.alias("k"), F.concat(F.lit("r"), k.cast("string")).alias("run_id"), F.lit(DAY).alias("day"), F.concat(F.lit("p"), k.cast("string")).alias("protocol_id"), F.lit(MODEL).alias("model_id"), sha.alias("protocol_sha256"))


def kept_trials(runs: DataFrame, protocols: DataFrame) -> DataFrame:
    """Trials as they were kept, some of them altered since."""
    k, i = F.col("k"), F.col("index")
    made = V.calls(runs, protocols).withColumn("k", F.substr("run_id", F.lit(2)).cast("long"))
    reply = F.element_at(F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(r, ("text", "error", "stop_reason")))) for r in REPLIES)), ((k * 31 + i) % len(REPLIES) + 1).cast("int"))
    rows = made.where(~((k % 11 == 5) & (i == 23))).select("*", reply.alias("r")).select("*", "r.*").drop("r")
    letter = F.when(F.lower("text").contains("decision: a"), "A").when(F.lower("text").contains("decision: b"), "B")
    outcome = F.when(F.col("error").isNotNull(), "blocked_upstream").when(F.col("stop_reason") == "refusal", "refused").when(letter.isNull(), "unparseable").otherwise("valid")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("stop_reason") == "refusal", "stop_reason=refusal").when(letter.isNull(), "no_decision_line")
    flipped = F.when((k % 13 == 6) & (i < 3), F.translate(letter, "AB", "BA")).otherwise(letter)
    return rows.select(
        "run_id", "k", "index", "version", "scenario_id", (F.col("rep") + F.when((k % 11 == 3) & (i == 5), 1).otherwise(0)).alias("rep"),
        F.when((k % 11 == 4) & (i == 7), "0").otherwise(F.col("prompt_sha256")).alias("prompt_sha256"),
        "text", "error", "stop_reason", outcome.alias("outcome"), F.when(outcome == "valid", flipped).alias("token"), reason.alias("reason"),
    )


def measured(trials: DataFrame) -> DataFrame:
    rows = counts.with_pairs(counts.tally(trials, ["run_id"]))
    return rows.select("run_id", *(F.col(f"valid_{v}").alias(f"valid_{v.lower()}") for v in VERSIONS), counts.stability().alias("stability_pct"), F.lit("code2").alias(V.CODE))


def _sql() -> str:
    values = ", ".join("(" + ", ".join([str(n), *("NULL" if x is None else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in r)]) + ")" for n, r in enumerate(REPLIES))
    n = len(VERSIONS) * SCENARIOS * REPS
    mixed = "CAST(seed AS UHUGEINT)"
    z = f"({mixed} + ({n} - i)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT"
    step = lambda z, shift, times: f"(xor({z}, {z} >> {shift}) * {times}::UHUGEINT) % 18446744073709551616::UHUGEINT"
    return f""" WITH RECURSIVE x(n, text, error, stop) AS (VALUES {values}),
p AS (SELECT p_partkey AS k, 'r' || p_partkey AS run_id, p_name AS name, CAST('0x' || substr(sha256('p' || p_partkey || '‖{DAY}‖{MODEL}‖order'), 1, 16) AS UBIGINT) AS seed FROM part),
draws AS (SELECT k, i, {z} AS z FROM p, (SELECT unnest(range(1, {n})) AS i)),
d1 AS (SELECT k, i, {step('z', 30, 13787848793156543929)} AS z FROM draws), d2 AS (SELECT k, i, {step('z', 27, 10723151780598845931)} AS z FROM d1),
d AS (SELECT k, list(CAST(xor(z, z >> 31) % (i + 1)::UHUGEINT AS INTEGER) ORDER BY i) AS js FROM d2 GROUP BY k),
sh AS (SELECT k, {n - 1} AS i, range(0, {n}) AS a, js FROM d UNION ALL
  SELECT k, i - 1, list_transform(range(0, {n}), lambda q: CASE WHEN q = i THEN a[js[i] + 1] WHEN q = js[i] THEN a[i + 1] ELSE a[q + 1] END), js FROM sh WHERE i > 0),
o AS (SELECT k, unnest(range(0, {n})) AS idx, unnest(a) AS call FROM sh WHERE i = 0),
c AS (SELECT p.k, run_id, idx, ['A', 'A_prime', 'B', 'C'][1 + call // {SCENARIOS * REPS}] AS version, 's' || (call // {REPS} % {SCENARIOS}) AS scenario, call % {REPS} AS rep,
  sha256('Read ' || ['A', 'A_prime', 'B', 'C'][1 + call // {SCENARIOS * REPS}] || ' ' || (call // {REPS} % {SCENARIOS}) || ': ' || name) AS sha FROM o JOIN p ON p.k = o.k WHERE p.k % 7 <> 1),
t AS (SELECT c.*, x.text, x.error, x.stop, rep + CASE WHEN k % 11 = 3 AND idx = 5 THEN 1 ELSE 0 END AS kept_rep, CASE WHEN k % 11 = 4 AND idx = 7 THEN '0' ELSE sha END AS kept_sha,
  upper(regexp_extract(lower(regexp_replace(x.text, '[*]', '', 'g')), '(^|\\n)decision: ([ab])\\.?$', 2)) AS said FROM c JOIN x ON x.n = (k * 31 + idx) % {len(REPLIES)} WHERE NOT (k % 11 = 5 AND idx = 23)),
f AS (SELECT *, error IS NULL AND stop <> 'refusal' AND said <> '' AS valid FROM t),
g AS (SELECT *, CASE WHEN valid THEN CASE WHEN k % 13 = 6 AND idx < 3 THEN translate(said, 'AB', 'BA') ELSE said END END AS token FROM f),
w AS (SELECT k, count(*) AS kept, min(CASE WHEN kept_rep <> rep OR kept_sha <> sha THEN idx END) AS place, count(*) FILTER (WHERE valid AND token <> said) AS changed,
  count(*) FILTER (WHERE kept_rep <> rep) > 0 AS other_call,
  count(*) FILTER (WHERE valid AND version = 'A') AS na, count(*) FILTER (WHERE valid AND version = 'B') AS nb FROM g GROUP BY k),
r AS (SELECT p.k, p.run_id, w.*  EXCLUDE (k), CASE WHEN p.k % 17 = 7 AND na > 0 AND nb > 0 THEN 'stability_pct' WHEN p.k % 17 = 9 THEN 'valid_b' END AS field, p.k % 17 IN (8, 9) AS code FROM p LEFT JOIN w ON w.k = p.k),
q AS (SELECT run_id, CASE WHEN k % 7 = 1 THEN 'protocol_hash: missing' ELSE concat_ws('; ', CASE WHEN k % 7 = 2 THEN 'protocol_hash: differs' END,
  CASE WHEN kept <> {n} THEN 'prompts: count {n}/' || kept WHEN place IS NOT NULL THEN 'prompts: ' || CASE WHEN other_call THEN 'call ' ELSE 'hash ' END || place END,
  CASE WHEN changed > 0 THEN 'classification: ' || changed END, CASE WHEN field IS NOT NULL THEN 'measurement: ' || CASE WHEN code THEN 'analysis_code_sha, ' ELSE '' END || field END) END AS problems,
  CASE WHEN k % 7 <> 1 AND code AND field IS NULL THEN 'analysis_code_sha' ELSE '' END AS notes FROM r)
SELECT run_id, problems = '' AS ok, problems, notes FROM q"""


def op_revalidation(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each run, all runs audited."""
    protocols, runs = declared(spark, folder), kept_runs(spark, folder)
    trials = materialize(kept_trials(runs, protocols), "audit-trials")
    rebuilt = materialize(measured(trials), "audit-measured")
    k = F.substr("run_id", F.lit(2)).cast("long")
    altered = {"stability_pct": F.col("stability_pct") + F.when(k % 17 == 7, 1.0).otherwise(0.0), "valid_b": F.col("valid_b") + F.when(k % 17 == 9, 1).otherwise(0), V.CODE: F.when((k % 17).isin(8, 9), "code1").otherwise(F.col(V.CODE))}
    found = V.audit(runs.drop("k"), protocols, trials.drop("k"), rebuilt.withColumns(altered), rebuilt)
    return found.select("run_id", "ok", F.array_join("problems", "; ").alias("problems"), F.array_join("notes", ", ").alias("notes"))


QUERIES["op_revalidation"], SQL["op_revalidation"] = op_revalidation, _sql()
