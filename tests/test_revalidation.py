"""The daily choice of runs, and that every kind of problem occurs in the audit's query."""

import hashlib

from pyspark.sql import functions as F

from evenkeel.jobs import registry
from evenkeel.operators import revalidation as V


def test_a_day_always_takes_the_same_runs(spark):
    names = [f"run_{k}" for k in range(50)]
    runs = spark.createDataFrame([(n,) for n in names], "run_id string")
    for day in ("2026-01-31", "2026-02-01"):
        want = sorted(names, key=lambda n: hashlib.sha256(f"{day}:{n}".encode()).hexdigest())[:4]
        assert [r.run_id for r in V.choose(runs.repartition(3), F.lit(day), 4).collect()] == want


def test_every_problem_is_found(spark, data):
    rows = registry.QUERIES["op_revalidation"](spark, data).collect()
    kinds = {p.rsplit(" ", 1)[0] if p.startswith(("prompts: call", "prompts: hash", "classification")) else p for r in rows for p in r.problems.split("; ") if p}
    assert kinds == {"protocol_hash: missing", "protocol_hash: differs", "prompts: call", "prompts: hash", "prompts: count 24/23", "classification:", "measurement: stability_pct", "measurement: analysis_code_sha, valid_b"}
    assert any(r.ok and not r.notes for r in rows) and any(r.ok and r.notes == "analysis_code_sha" for r in rows)
    assert all(r.ok == (r.problems == "") for r in rows)


def test_nothing_to_audit(spark, data):
    from evenkeel.jobs import revalidating as J

    runs, protocols = J.kept_runs(spark, data).limit(0), J.declared(spark, data)
    trials = J.kept_trials(runs, protocols)
    rebuilt = J.measured(trials)
    assert V.audit(runs.drop("k"), protocols, trials.drop("k"), rebuilt, rebuilt).count() == 0


def test_trials_are_read_in_order_whatever_was_done_to_them(spark, data):
    """Trials kept twice, lost or beyond plain text; each run's trials meet its schedule in one join, and no protocol's grammar is read by a plan of its own."""
    from evenkeel.jobs import revalidating as J
    from evenkeel.sources.tables import materialize

    chosen = {"r21": 21, "r28": 28, "r35": 35, "r42": 42}  # whole runs
    runs = J.kept_runs(spark, data).where(F.col("k").isin(*chosen.values()))
    protocols = J.declared(spark, data)
    trials = materialize(J.kept_trials(runs, protocols), "test-trials").drop("k")
    rebuilt = materialize(J.measured(trials), "test-measured")
    problems = lambda kept: {r.run_id: r.problems for r in V.audit(runs.drop("k"), protocols, kept, rebuilt, rebuilt).collect()}
    assert problems(trials) == {r: [] for r in chosen}
    of = lambda run, index: (F.col("run_id") == run) & (F.col("index") == index)
    twice = trials.unionByName(trials.where(of("r21", 3) | of("r28", 3))).where(~of("r28", 9))
    odd = twice.withColumn("text", F.when(of("r35", 4), "é\nDecision：B").otherwise(F.col("text"))).where("run_id <> 'r42'")
    odd = odd.withColumns({c: F.when(of("r35", 4), F.lit(None)).otherwise(F.col(c)) for c in ("error", "reason")} | {"stop_reason": F.when(of("r35", 4), "end_turn").otherwise(F.col("stop_reason")), "outcome": F.when(of("r35", 4), "valid").otherwise(F.col("outcome")), "token": F.when(of("r35", 4), "A").otherwise(F.col("token"))})
    assert problems(odd) == {"r21": ["prompts: count 24/25"], "r28": ["prompts: call 3"], "r35": ["classification: 1"], "r42": ["prompts: count 24/0"]}
    plan = V.audit(runs.drop("k"), protocols, trials, rebuilt, rebuilt)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "stop_reason#" in line for line in plan.splitlines()) == 2  # plain texts and others, not once for each grammar and case
