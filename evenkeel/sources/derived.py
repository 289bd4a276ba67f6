"""Entities of the data model as views over the given tables.

Each view is a DataFrame function and, under the same name in VIEWS, the same definition
in portable SQL, from which tests and checks rebuild it elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources.tables import table

N_SCENARIOS = 15


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, place, version, scenario_id, outcome, token of every call."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    key = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    which = key % 4
    version = F.when(which == 0, "A").when(which == 1, "A_prime").when(which == 2, "B").otherwise("C")
    bar = F.when(which == 2, 34.59).when(which == 3, 113.28).otherwise(18.16)
    outcome = F.when((F.col("event_type") == "error") & (key % 7 == 0), "unparseable").when((F.col("event_type") == "signup") & (key % 97 == 0), "refused").otherwise("valid")
    return e.select(
        F.concat(F.lit("run_"), two(F.col("user_id") % 12)).alias("run_id"),
        key.alias("place"),
        version.alias("version"),
        F.concat(F.lit("s"), two(1 + F.floor(key / 4) % N_SCENARIOS)).alias("scenario_id"),
        outcome.alias("outcome"),
        F.when(outcome == "valid", F.when(F.col("value") < bar, "A").otherwise("B")).alias("token"),
    )


def panels(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, scenario_id: the declared panel of every run."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(N_SCENARIOS)), lambda i: F.concat(F.lit("s"), F.lpad(i.cast("string"), 2, "0")))
    return trials(spark, folder).select("run_id").distinct().select("run_id", F.explode(ids).alias("scenario_id"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Past measurements: protocol_id, series, model_id, run_date, run_id, stability, interval, bound, on_curve."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    stability = 60 + F.floor("o_totalprice") % 160 / 4
    half = (1 + k % 7) / 2
    return o.select(
        F.concat(F.lit("p"), F.lpad((F.col("o_custkey") % 97).cast("string"), 2, "0")).alias("protocol_id"),
        F.when(F.col("o_custkey") % 2 == 0, "commercial").otherwise("open_weights").alias("series"),
        F.concat(F.lit("model_"), (k % 3).cast("string")).alias("model_id"),
        F.to_date("o_orderdate").alias("run_date"),
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 9, "0")).alias("run_id"),
        F.when(k % 23 != 0, stability).alias("stability_pct"),
        F.when(k % 23 != 0, stability - half).alias("ci_low_pct"),
        F.when(k % 23 != 0, stability + half).alias("ci_high_pct"),
        (k % 5 / 4).alias("bound_pct"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("on_curve"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """The scheduler's log: place, job, day, ran, cause."""
    e = table(spark, folder, "events").select("event_id", "ts", "event_type")
    k = F.col("event_id")
    ran = k % 13 != 0
    cause = F.when(k % 3 == 0, "budget_halted").when(k % 3 == 1, "runner_error").otherwise("not_due")
    return e.select(k.alias("place"), F.col("event_type").alias("job"), F.to_date("ts").alias("day"), ran.alias("ran"), F.when(~ran, cause).alias("cause"))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The model log: place, family, model_id, day, event."""
    e = table(spark, folder, "events").select("event_id", "ts", "event_type", "user_id")
    k = F.col("event_id")
    event = F.when(k % 11 == 0, "gone").when(k % 17 == 0, "bridge_waived").when(k % 5 == 0, "baseline").otherwise("appeared")
    return e.select(k.alias("place"), F.col("event_type").alias("family"), F.concat(F.lit("m"), (F.col("user_id") % 60).cast("string")).alias("model_id"), F.to_date("ts").alias("day"), event.alias("event"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Raw replies: conv_id, turn, text, error, stop_reason, from conversation texts with a closing line."""
    c = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    k = (F.col("conv_id") + F.col("turn")) % 10
    last = (
        F.when(k == 0, "DECISION: A").when(k == 1, "**Decision: B**").when(k == 2, "decision: a.").when(k == 3, "Decision：B")
        .when(k == 4, "DECISION: A\nDecision: B").when(k == 5, "Decision: C").when(k == 6, "no verdict").when(k == 7, "decision:  `B` !")
        .when(k == 8, "Decision: depends\nDECISION: B").otherwise("DECISION: A\ndecision: a")
    )
    m = (F.col("conv_id") * 7 + F.col("turn")) % 29
    return c.select(
        "conv_id",
        "turn",
        F.when(m == 3, F.lit(None).cast("string")).when(m == 4, F.lit(" \n ")).otherwise(F.concat(F.col("text"), F.lit("\n"), last)).alias("text"),
        F.when(m == 0, "timeout").alias("error"),
        F.when(m.isin(0, 1), "refusal").when(m == 2, "max_tokens").otherwise("end_turn").alias("stop_reason"),
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Spend: run_id, run_date, category, amount (exact), note."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    note = F.when(F.col("o_orderkey") % 4 == 0, "measured; not yet reconciled against the bill").otherwise("bill")
    return o.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.to_date("o_orderdate").alias("run_date"),
        F.when(F.col("o_orderstatus") == "F", "sweep").when(F.col("o_orderstatus") == "O", "guard").otherwise("bridge").alias("category"),
        (F.floor("o_totalprice").cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").alias("amount"),
        note.alias("note"),
    )


def protocols(spark: SparkSession, folder: str) -> DataFrame:
    """Protocol headers from parts: protocol_id, family, type, n, status, lane, twin_id, panel, grammar."""
    p = table(spark, folder, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    k = F.col("p_partkey")
    family = F.concat(F.lit("family_"), (F.floor(k / 8) % 50).cast("string"))
    kind = F.when(k % 4 == 0, "wording").when(k % 4 == 1, "order").when(k % 4 == 2, "default").otherwise("anchoring")
    version = (F.floor(k / 400)).cast("string")
    status = F.when(k % 9 == 0, "candidate").when(k % 31 == 0, "retired").otherwise("admitted")
    return p.select(
        k.alias("place"),
        F.concat_ws("__", family, kind, F.concat(F.lit("v"), version)).alias("protocol_id"),
        family.alias("family"),
        kind.alias("rewording_type"),
        (30 + 90 * (k % 2)).cast("int").alias("n"),
        status.alias("status"),
        F.when(k % 9 != 0, F.when(F.col("p_size") % 2 == 0, "open").otherwise("guard")).alias("lane"),
        F.when((k % 9 != 0) & (k % 10 != 3), F.when(k % 2 == 0, k + 1).otherwise(k - 1)).alias("twin"),
        F.sha2(F.concat(F.lit("panel"), (k % 300).cast("string")), 256).alias("panel_sha256"),
        F.sha2(F.concat(F.lit("protocol"), k.cast("string")), 256).alias("protocol_sha256"),
        (1 + k % 2).cast("int").alias("grammar_version"),
    )


VIEWS = {
    "trials": """
SELECT 'run_' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS run_id, event_id AS place,
  CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A_prime' WHEN 2 THEN 'B' ELSE 'C' END AS version,
  's' || lpad(CAST(1 + (event_id // 4) % 15 AS VARCHAR), 2, '0') AS scenario_id, o AS outcome,
  CASE WHEN o = 'valid' THEN CASE WHEN value < CASE event_id % 4 WHEN 2 THEN 34.59 WHEN 3 THEN 113.28 ELSE 18.16 END THEN 'A' ELSE 'B' END END AS token
FROM (SELECT *, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'unparseable' WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'refused' ELSE 'valid' END AS o FROM events)""",
    "history": """
SELECT 'p' || lpad(CAST(o_custkey % 97 AS VARCHAR), 2, '0') AS protocol_id, CASE WHEN o_custkey % 2 = 0 THEN 'commercial' ELSE 'open_weights' END AS series,
  'model_' || (o_orderkey % 3) AS model_id, CAST(o_orderdate AS DATE) AS run_date, 'r' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS run_id,
  CASE WHEN o_orderkey % 23 <> 0 THEN s END AS stability_pct, CASE WHEN o_orderkey % 23 <> 0 THEN s - h END AS ci_low_pct, CASE WHEN o_orderkey % 23 <> 0 THEN s + h END AS ci_high_pct,
  CAST(o_orderkey % 5 AS DOUBLE) / 4 AS bound_pct, o_orderpriority IN ('1-URGENT', '2-HIGH') AS on_curve
FROM (SELECT *, 60 + CAST(CAST(floor(o_totalprice) AS BIGINT) % 160 AS DOUBLE) / 4 AS s, CAST(1 + o_orderkey % 7 AS DOUBLE) / 2 AS h FROM orders)""",
    "observations": """
SELECT event_id AS place, event_type AS job, CAST(ts AS DATE) AS day, event_id % 13 <> 0 AS ran,
  CASE WHEN event_id % 13 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'budget_halted' WHEN 1 THEN 'runner_error' ELSE 'not_due' END END AS cause FROM events""",
    "registry": """
SELECT event_id AS place, event_type AS family, 'm' || (user_id % 60) AS model_id, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 11 = 0 THEN 'gone' WHEN event_id % 17 = 0 THEN 'bridge_waived' WHEN event_id % 5 = 0 THEN 'baseline' ELSE 'appeared' END AS event
FROM events""",
    "responses": """
SELECT conv_id, turn, CASE m WHEN 3 THEN NULL WHEN 4 THEN ' ' || chr(10) || ' ' ELSE text || chr(10) || CASE k WHEN 0 THEN 'DECISION: A' WHEN 1 THEN '**Decision: B**' WHEN 2 THEN 'decision: a.'
  WHEN 3 THEN 'Decision：B' WHEN 4 THEN 'DECISION: A' || chr(10) || 'Decision: B' WHEN 5 THEN 'Decision: C' WHEN 6 THEN 'no verdict' WHEN 7 THEN 'decision:  `B` !'
  WHEN 8 THEN 'Decision: depends' || chr(10) || 'DECISION: B' ELSE 'DECISION: A' || chr(10) || 'decision: a' END END AS text,
  CASE WHEN m = 0 THEN 'timeout' END AS error, CASE WHEN m IN (0, 1) THEN 'refusal' WHEN m = 2 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason
FROM (SELECT *, (conv_id + turn) % 10 AS k, (conv_id * 7 + turn) % 29 AS m FROM conversations)""",
    "ledger": """
SELECT 'r' || o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS run_date, CASE o_orderstatus WHEN 'F' THEN 'sweep' WHEN 'O' THEN 'guard' ELSE 'bridge' END AS category,
  CAST(CAST(floor(o_totalprice) AS BIGINT) AS DECIMAL(20,2)) / 100 AS amount_d, CAST(floor(o_totalprice) AS BIGINT) AS cents,
  CASE WHEN o_orderkey % 4 = 0 THEN 'measured; not yet reconciled against the bill' ELSE 'bill' END AS note FROM orders""",
    "protocols": """
SELECT p_partkey AS place, family || '__' || kind || '__v' || (p_partkey // 400) AS protocol_id, family, kind AS rewording_type, CAST(30 + 90 * (p_partkey % 2) AS INTEGER) AS n,
  CASE WHEN p_partkey % 9 = 0 THEN 'candidate' WHEN p_partkey % 31 = 0 THEN 'retired' ELSE 'admitted' END AS status,
  CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'guard' END END AS lane,
  CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 10 <> 3 THEN CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 1 ELSE p_partkey - 1 END END AS twin,
  sha256('panel' || (p_partkey % 300)) AS panel_sha256, sha256('protocol' || p_partkey) AS protocol_sha256, CAST(1 + p_partkey % 2 AS INTEGER) AS grammar_version
FROM (SELECT *, 'family_' || ((p_partkey // 8) % 50) AS family, CASE p_partkey % 4 WHEN 0 THEN 'wording' WHEN 1 THEN 'order' WHEN 2 THEN 'default' ELSE 'anchoring' END AS kind FROM part)""",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views (space separated) in front of `body`."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names.split()) + ("," if body.lstrip().startswith(",") else "") + body.lstrip().lstrip(",")
