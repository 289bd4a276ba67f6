"""Measurements near each other in time: against plain loops, and for very many runs of one key in a week."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import history as H
from evenkeel.operators import protocols as P

ROW = "protocol_id string, series string, model_id string, run_date date, run_id string, stability_pct double, ci_low_pct double, ci_high_pct double, bound_pct double"


def made_history(seed, n, models, span):
    rng = np.random.default_rng(seed)
    day = lambda: None if rng.random() < 0.05 else date(2026, 1, 1) + timedelta(int(rng.integers(0, span)))
    return [(f"p{rng.integers(0, 3)}", "s" if rng.random() < 0.9 else None, f"m{rng.integers(0, models)}", day(), f"r{k:03}", 50.0, 40.0, 60.0, 1.0) for k in rng.permutation(n)]


@pytest.mark.parametrize(("seed", "n", "models", "span"), [(1, 60, 3, 200), (2, 80, 4, 20), (3, 40, 2, 400)])
def test_closest_pairs_equal_all_pairs(spark, seed, n, models, span):
    rows = made_history(seed, n, models, span)
    best = {}
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[1] and a[2] != b[2] and a[3] and b[3] and abs((a[3] - b[3]).days) <= 7:
                key = (a[0], a[1], a[2], b[2])
                rank = (abs((a[3] - b[3]).days), -a[3].toordinal(), a[4], b[4])
                best[key] = min(best.get(key, rank), rank)
    got = {(r.protocol_id, r.series, r.this_model, r.other_model): (r.gap, -r.this.run_date.toordinal(), r.this.run_id, r.other.run_id) for r in H.closest(spark.createDataFrame(rows, ROW)).collect()}
    assert got == best and best


@pytest.mark.parametrize("days", [0, 1, 7])
def test_rows_that_have_a_near_one(spark, days):
    rng = np.random.default_rng(days)
    day = lambda: date(2026, 1, 1) + timedelta(int(rng.integers(-300, 300)))
    left = [(int(rng.integers(0, 4)), day()) for _ in range(80)] + [(1, None)]
    right = [(int(rng.integers(0, 4)), day()) for _ in range(40)] + [(1, None), (9, None)]
    got = H.having_near(spark.createDataFrame(left, "k int, x date"), spark.createDataFrame(right, "k int, y date"), ["k"], "x", "y", days).collect()
    want = [(k, x) for k, x in left if x and any(k == q and y and abs((x - y).days) <= days for q, y in right)]
    assert sorted((r.k, r.x) for r in got) == sorted(want)


def test_many_runs_of_one_key_in_a_week(spark):
    """50,000 runs are compared as the days that they fall on."""
    runs = spark.range(50_000).select(F.lit("p").alias("protocol_id"), F.lit("s").alias("series"), F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model_id"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("run_date"), F.format_string("r%06d", "id").alias("run_id"), *(F.lit(50.0).alias(c) for c in H.FIGURES[2:]))
    found = H.closest(runs).collect()
    assert {(r.this_model, r.this.run_id, r.other.run_id) for r in found} == {("m0", "r000006", "r000013"), ("m1", "r000013", "r000006")}
    left = runs.select("protocol_id", F.col("run_date").alias("x"))
    assert H.having_near(left, runs.select("protocol_id", "run_date"), ["protocol_id"], "x", "run_date").count() == 50_000


def test_a_bridge_may_come_from_any_run_on_the_panel(spark):
    rows = [(1, "f__a__v1", "x"), (2, "f__a__v2", "y"), (3, "g__a__v1", "x"), (4, "g__a__v2", "z"), (5, "h__a__v1", "w"), (6, "h__a__v2", "v")]
    protocols = spark.createDataFrame(rows, "place long, protocol_id string, panel_sha256 string").withColumns({"status": F.lit("admitted"), "lane": F.lit("open"), "twin": F.lit(None).cast("long")})
    runs = spark.createDataFrame([(3, "m", date(2026, 1, 1)), (2, "m", date(2026, 1, 8)), (4, "m", date(2026, 1, 9)), (5, "m", date(2026, 1, 1)), (6, "n", date(2026, 1, 1))], "line long, model_id string, day date")
    broken = {r.place: r.broken for r in P.declassification(protocols, runs).collect()}
    assert broken == {1: [], 2: ["still_current", "no_successor"], 3: ["no_bridge"], 4: ["still_current", "no_successor"], 5: ["no_bridge"], 6: ["still_current", "no_successor"]}


def test_a_bridge_needs_a_protocol_of_every_type(spark):
    rows = [(k, f"{f}__{t}__v{v}", t, n) for k, (f, t, v, n) in enumerate([("b", "wording", 0, 30), ("a", "wording", 0, 30), ("a", "wording", 1, 120), ("a", "order", 0, 30), ("c", "default", 0, 30), ("z", "anchoring", 2, 60)])]
    protocols = spark.createDataFrame(rows, "place int, protocol_id string, rewording_type string, n int").withColumn("status", F.lit("admitted"))
    plan = P.plan_bridge(protocols).first()
    assert plan.protocol_ids == ["a__wording__v1", "a__order__v0", "c__default__v0", "z__anchoring__v2"] and (plan.calls_per_model, plan.calls_total) == (960, 1920)
    for lost in ("order", "anchoring"):
        with pytest.raises(Exception, match=f"no admitted protocol for type.*{lost}"):
            P.plan_bridge(protocols.where(F.col("rewording_type") != lost)).collect()
    with pytest.raises(Exception, match="wording, order, default, anchoring"):
        P.plan_bridge(protocols.limit(0)).collect()
