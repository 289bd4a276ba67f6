"""Hand-worked values of the exact statistics, gates and resampling."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.functions.exact import published
from evenkeel.jobs import reading, registry
from evenkeel.operators import counts, gates, resampling, scenarios


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def arr(values):
    return F.array(*(F.lit(v).cast("long") for v in values))


@pytest.mark.parametrize("x, y, gap", [((3, 3), (6, 6), 0), ((5, 0), (0, 5), 1), ((0, 0), (3, 2), None), ((3, 1), (1, 3), Fraction(1, 2)), ((1, 2, 3), (3, 2, 1), Fraction(1, 3))])
def test_distance(spark, x, y, gap):
    num, den = counts.distance(arr(x), arr(y))
    row = one(spark, num=num, den=den)
    assert (None if row.num is None else Fraction(int(row.num), int(row.den))) == gap


@pytest.mark.parametrize("c, h", [((5, 5), 1.0), ((10, 0), 0.0), ((0, 0), None), ((3, 1), 0.811278124459), ((2, 3, 5), 0.937230563216)])
def test_entropy(spark, c, h):
    found = one(spark, h=counts.entropy(arr(c), len(c))).h
    assert found == h or abs(found - h) < 1e-9


def test_entropy_of_one_option_is_undefined(spark):
    assert one(spark, h=counts.entropy(arr((7,)), 1)).h is None


@pytest.mark.parametrize("num, den", [(1, 3), (5, 2_000_000), (15, 2_000_000), (25, 2_000_000), (2, 3), (0, 7), (10**18, 3 * 10**17)])
def test_publication_is_half_even(spark, num, den):
    assert one(spark, v=published(F.lit(num), F.lit(den))).v == float(round(Fraction(num, den), 6))


def test_publication_without_a_denominator_is_null(spark):
    assert one(spark, v=published(F.lit(1), F.lit(0))).v is None


@pytest.mark.parametrize("x, y, seed, n, floor", [((5, 3), (2, 6), 42, 10_000, Fraction(8589, 40000)), ((10, 0), (0, 10), 7, 500, Fraction(441, 2500))])
def test_null_floor(x, y, seed, n, floor):
    nx, ny = sum(x), sum(y)
    assert Fraction(resampling.null_floor_sum(np.array(x), np.array(y), seed, n), 2 * nx * ny * n) == floor


@pytest.mark.parametrize("block", [1, 7, 40])
def test_null_floor_is_the_same_in_blocks(spark, block):
    """Blocks of one run, counted apart from each other, against the pool carried through all iterations."""
    runs = spark.createDataFrame([("a", [5, 3], [2, 6], "42"), ("b", [9, 1, 4], [3, 3, 8], "7"), ("c", [1, 0], [0, 1], "9"), ("none", [0, 0], [4, 1], "5"), ("null", None, [4, 1], "5")], "run_id string, cx array<bigint>, cy array<bigint>, seed string")
    found = {r.run_id: (r.floor_num, r.floor_den) for r in resampling.null_floor(runs, 40, after_bootstrap=3, block=block).collect()}
    for r in runs.collect():
        if r.cx is None or not sum(r.cx):
            assert found[r.run_id] == (None, None)
            continue
        nx, ny = sum(r.cx), sum(r.cy)
        assert found[r.run_id] == (resampling.null_floor_sum(np.array(r.cx), np.array(r.cy), int(r.seed), 40, 3 * (nx + ny)), 2 * nx * ny * 40)


def test_permutations_of_blocks_compose():
    whole = resampling.block_permutation(12, 5, 77, 0, 9)
    first, then = resampling.block_permutation(12, 5, 77, 0, 4), resampling.block_permutation(12, 5, 77, 20, 5)
    assert whole.tolist() == first[then].tolist() and sorted(whole) == list(range(12))


@pytest.mark.parametrize("nx, ny", [(60, 70), (1, 300), (300, 1), (900, 40)])
def test_many_swaps_at_a_time_are_those_made_one_by_one(monkeypatch, nx, ny):
    """Pools so small that most swaps meet others, and iterations in pieces of few draws."""
    monkeypatch.setattr(resampling, "MOST_DRAWS", 200)
    pool = np.arange(nx + ny, dtype=np.int32)
    for want, found in zip(resampling._splits(list(range(nx + ny)), nx, 2**64 - 9, 31, 25), resampling._large_splits(pool, nx, 2**64 - 9, 31, 25)):
        assert want == found.tolist()
    x, y = np.array([nx // 2, nx - nx // 2, 0]), np.array([ny - ny // 3, 0, ny // 3])
    ask = lambda: (resampling.null_floor_sum(x, y, 8, 25, 3), resampling.block_permutation(nx + ny, nx, 8, 3, 25).tolist())
    small = ask()
    monkeypatch.setattr(resampling, "LARGE", 0)
    assert ask() == small


def test_runs_are_cut_into_blocks_only_for_idle_tasks():
    assert [resampling._block(runs, tasks, 10_000) for runs, tasks in ((12, 6), (12, 8), (1000, 6), (2, 8), (12, 100))] == [10_000, 10_000, 10_000, 2_500, 1_250]


def sequential(seed, n):
    state = seed
    for _ in range(n):
        state = (state + resampling.STEP) % 2**64
        z = (state ^ (state >> 30)) * resampling.FIRST % 2**64
        z = (z ^ (z >> 27)) * resampling.SECOND % 2**64
        yield z ^ (z >> 31)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 50), st.integers(1, 50))
def test_draws_are_those_of_the_sequential_generator(seed, start, n):
    assert resampling.draws(seed, start, n).tolist() == list(sequential(seed, start + n))[start:]


def test_bootstrap_blocks_make_one_sequence(spark):
    x, y, seed = np.array([7, 5]), np.array([4, 9]), 99
    draw = sequential(seed, 40 * 25)
    want = []
    for _ in range(40):
        a = sum(next(draw) % 12 < 7 for _ in range(12))
        b = sum(next(draw) % 13 < 4 for _ in range(13))
        want.append(abs(a * 13 - b * 12) + abs((12 - a) * 13 - (13 - b) * 12))
    got = np.concatenate([resampling.bootstrap_block(x, y, seed, k, 10) for k in (0, 10, 20, 30)])
    for most in (3, int(x.sum() + y.sum()) - 1, 100):  # however few draws are held at once
        assert np.array_equal(got, resampling.bootstrap_block(x, y, seed, 0, 40, most))
    assert got.tolist() == want
    runs = spark.createDataFrame([("r", [7, 5], [4, 9], "99"), ("empty", [0, 0], [1, 1], "5")], "run_id string, cx array<bigint>, cy array<bigint>, seed string")
    row = resampling.bootstrap(runs, 40).collect()
    assert [(r.run_id, r.low_num, r.high_num) for r in row] == [("r", sorted(want)[0], sorted(want)[38])]
    assert {r.run_id: r.floor_num is None for r in resampling.null_floor(runs, 10).collect()} == {"r": False, "empty": True}


def test_registered_queries_resample_in_full_from_one_stream(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").where("user_id % 12 < 2 and event_id < 300").write.parquet(f"{tmp_path}/events.parquet")
    ask = lambda name: {r.run_id: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    ci, floor, whole = ask("op_bootstrap_ci"), ask("op_null_floor"), ask("op_measurement")
    runs = reading._runs(spark, str(tmp_path)).collect()
    assert len(runs) == len(whole) == 2
    for r in runs:
        (a, b), (c, d), n = r.cx, r.cy, 10_000
        nx, ny, den = a + b, c + d, 2 * (a + b) * (c + d)
        apart = lambda x, y: abs(x * ny - y * nx) + abs((nx - x) * ny - (ny - y) * nx)
        draw = sequential(int(r.seed), n * (2 * nx + ny))
        nums = sorted(apart(sum([next(draw) % nx < a for _ in range(nx)]), sum([next(draw) % ny < c for _ in range(ny)])) for _ in range(n))
        pool, total = [1] * (a + c) + [0] * (b + d), 0
        for _ in range(n):
            for i in range(nx):
                j = i + next(draw) % (nx + ny - i)
                pool[i], pool[j] = pool[j], pool[i]
            total += apart(sum(pool[:nx]), a + c - sum(pool[:nx]))
        low, high, pct = nums[n // 40 - 1], nums[n - n // 40 - 1], round(100 * total / (den * n), 6)
        found = whole[r.run_id]
        assert (ci[r.run_id].low_num, ci[r.run_id].high_num, ci[r.run_id].den) == (low, high, den)
        assert floor[r.run_id].null_floor_pct == pytest.approx(pct, abs=1e-6) and found.null_floor_pct == pytest.approx(pct, abs=1e-6)
        assert found.ci_low_pct == pytest.approx(100 - 100 * high / den, abs=1e-6) and found.ci_high_pct == pytest.approx(100 - 100 * low / den, abs=1e-6)
        assert found.at_noise_floor == (Fraction(apart(a, c), den) <= Fraction(total, den * n))


def test_replies_drawn_again_are_counted_however_many(monkeypatch):
    """Options of any number, none of them or one alone, against counting each draw; no more draws at once than a cache holds."""
    assert resampling.MOST_DRAWS <= 2**16
    made = resampling.draws(2**63 + 5, 12, 700).reshape(7, 100)
    for counts in ([3, 0, 4, 1], [9], [0, 5], [40_000, 30_000]):
        counts = np.array(counts)
        replies = np.repeat(np.arange(len(counts)), counts)
        want = [np.bincount(replies[(row % np.uint64(len(replies))).astype(int)], minlength=len(counts)).tolist() for row in made]
        assert resampling._redrawn(made.copy(), counts).tolist() == want


def test_call_order_is_a_seeded_shuffle():
    order, draw = list(range(20)), sequential(5, 19)
    for i in range(19, 0, -1):
        j = next(draw) % (i + 1)
        order[i], order[j] = order[j], order[i]
    assert resampling.call_order(5, 20) == order


def test_orders_made_together_are_those_of_each_seed(spark, monkeypatch):
    sizes = [24] * 300 + [7] * 150 + [0, 1, 5000] + [None]
    rows = spark.createDataFrame([(f"p{k}", n, str(2**64 - 1 - k * 10**16)) for k, n in enumerate(sizes)], "protocol_id string, n_calls int, seed string").coalesce(1)
    ask = lambda: {r.protocol_id: (r.n_calls, r.order) for r in resampling.ordered(rows).collect()}
    found = ask()
    for k, n in enumerate(sizes):
        assert found[f"p{k}"] == (n, None if n is None else resampling.call_order(2**64 - 1 - k * 10**16, n))
    monkeypatch.setattr(resampling, "MOST_CALLS", 50)
    assert ask() == found
    pairs = [(r.place, r.call) for r in resampling.call_orders(rows.where("protocol_id = 'p3'")).collect()]
    assert pairs == list(enumerate(found["p3"][1]))


def judged(spark, c, n, theta=10, share=50, concentration=20.0, grammar=1):
    row = {f"c_{v}": arr(c[v]) for v in c} | {f"valid_{v}": F.lit(sum(c[v])).cast("long") for v in c} | {f"n_{v}": F.lit(n[v]).cast("long") for v in c}
    rows = counts.with_pairs(spark.range(1).select(*(x.alias(k) for k, x in row.items())))
    lit = lambda v: F.lit(v).cast("decimal(12,6)")
    return gates.gates(rows, lit(theta), lit(share), F.lit(concentration), F.lit(grammar)).first()


FULL = {"A": 120, "A_prime": 120, "B": 120, "C": 120}


@pytest.mark.parametrize("c, flags", [
    ({"A": (90, 30), "A_prime": (90, 30), "B": (60, 60), "C": (20, 100)}, []),
    ({"A": (90, 30), "A_prime": (60, 60), "B": (60, 60), "C": (20, 100)}, ["below_surface_noise"]),
    ({"A": (90, 30), "A_prime": (90, 30), "B": (90, 30), "C": (20, 100)}, ["below_drop_bound", "below_surface_noise"]),
    ({"A": (90, 30), "A_prime": (90, 30), "B": (60, 60), "C": (85, 35)}, ["not_reading"]),
    ({"A": (120, 0), "A_prime": (120, 0), "B": (119, 1), "C": (120, 0)}, ["not_reading", "degenerate_candidate"]),
    ({"A": (80, 30), "A_prime": (90, 30), "B": (60, 60), "C": (20, 100)}, ["drop_confounded", "asymmetric_missingness"]),
])
def test_gates(spark, c, flags):
    row = judged(spark, c, FULL)
    assert row.flags == flags and row.all_passed == (not flags)


def test_unset_thresholds_are_undecided_and_not_failed(spark):
    c = {"A": (90, 30), "A_prime": (90, 30), "B": (60, 60), "C": (85, 35)}
    row = judged(spark, c, FULL, theta=None, share=None)
    assert row.reading is None and row.dominated is None and row.flags == [] and not row.all_passed
    assert row.unset == ["theta_positive_pct", "scenario_dominated_share_pct"]


def test_a_passing_control_lifts_the_degenerate_flag_of_later_grammars(spark):
    c = {"A": (120, 0), "A_prime": (120, 0), "B": (118, 2), "C": (0, 120)}
    assert judged(spark, c, FULL, grammar=1).flags == ["degenerate_candidate"]
    assert judged(spark, c, FULL, grammar=2).flags == []


def test_a_side_without_valid_replies_fails_its_gates(spark):
    c = {"A": (0, 0), "A_prime": (90, 30), "B": (60, 60), "C": (20, 100)}
    row = judged(spark, c, FULL)
    assert {"below_drop_bound", "below_surface_noise", "not_reading"} <= set(row.flags)


def test_undeclared_tokens_are_an_error(spark):
    rows = spark.createDataFrame([("r", "A", "valid", "Z")], "run_id string, version string, outcome string, token string")
    with pytest.raises(Exception, match="undeclared token"):
        counts.tally(rows, ["run_id"]).collect()


def test_scenarios_without_trials_have_null_gaps(spark):
    rows = spark.createDataFrame([("r", "s1", "A", "valid", "A"), ("r", "s1", "B", "valid", "B"), ("r", "s2", "A", "valid", "A")], "run_id string, scenario_id string, version string, outcome string, token string")
    panel = spark.createDataFrame([("r", "s1"), ("r", "s2"), ("r", "s3"), ("other", "s9")], "run_id string, scenario_id string")
    found = {(r.run_id, r.scenario_id): r.gap_pct for r in scenarios.gaps(rows, panel).collect()}
    assert found == {("r", "s1"): 100.0, ("r", "s2"): None, ("r", "s3"): None, ("other", "s9"): None}  # no scenario of another run's panel
    assert scenarios.spread(scenarios.gaps(rows, panel)).first().known == 1
    assert {r.scenario_id for r in scenarios.gaps(rows).collect()} == {"s1", "s2"}


def test_compare_uses_both_limits(spark):
    kind = "struct<stability_pct:double,ci_low_pct:double,ci_high_pct:double,bound_pct:double>"
    rows = [((90.0, 87.0, 93.0, 1.0), (95.0, 91.0, 99.0, 1.0), "improved"), ((95.0, 91.0, 99.0, 1.0), (90.0, 87.0, 93.0, 1.0), "regressed"), ((90.0, 87.0, 93.0, 1.0), (94.9, 90.9, 98.9, 1.0), "flat"),
            ((90.0, 89.0, 91.0, 1.0), (92.0, 91.0, 93.0, 1.0), "flat"), ((None, 89.0, 91.0, 1.0), (92.0, 91.0, 93.0, 1.0), None)]
    df = spark.createDataFrame(rows, f"x {kind}, y {kind}, want string")
    for r in df.withColumn("got", gates.compare("x", "y")).collect():
        assert r.got == r.want
