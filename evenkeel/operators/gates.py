"""Gates and flags of a measurement, compared as exact rationals and three-valued where a threshold may be unset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import vocabulary as V
from evenkeel.functions.exact import wide
from evenkeel.operators import counts


def _above(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def gates(rows: DataFrame, theta: Column, share: Column, concentration_pct: Column, grammar: Column) -> DataFrame:
    """Adds the verdict of each gate, `flags` in declared order, `unset` thresholds and `all_passed`.

    rows come from counts.with_pairs; theta and share are decimals or null.
    """
    gap_n, gap_d = (lambda p: F.col(f"gap_num_{p}")), (lambda p: F.col(f"gap_den_{p}"))
    loss_n, loss_d = (lambda p: F.col(f"bound_num_{p}")), (lambda p: F.col(f"loss_den_{p}"))
    within = lambda num, p, most: wide(num) * 100 <= wide(loss_d(p)) * most
    bounds_ok = [within(loss_n(p), p, V.DROP_BOUND_MAX_PCT) for p in V.PAIRS]
    asym_ok = [within(F.col(f"asym_num_{p}"), p, V.DROP_ASYMMETRY_MAX_PCT) for p in V.PAIRS]
    # gap - bound of a pair over one denominator
    net = lambda p: wide(gap_n(p)) * wide(loss_d(p)) - wide(loss_n(p)) * wide(gap_d(p))
    both = lambda p: wide(gap_n(p)) * wide(loss_d(p)) + wide(loss_n(p)) * wide(gap_d(p))
    den = lambda p: wide(gap_d(p)) * wide(loss_d(p))
    above_bound = _above(net("ab") > 0)
    # both denominators hold the calls and valid replies of A; the rest is crossed
    rest = lambda v: wide(F.col(f"n_{v}")) * wide(F.col(f"valid_{v}"))
    above_noise = _above(net("ab") * rest("A_prime") > both("aa") * rest("B"))
    reading = F.when(theta.isNotNull(), _above((net("ac") * 100).cast("decimal(38,0)") > (den("ac") * theta).cast("decimal(38,6)")))
    h_a, h_b = counts.entropy(F.col("c_A"), 2), counts.entropy(F.col("c_B"), 2)
    steady = h_a.isNotNull() & h_b.isNotNull() & (F.greatest(h_a, h_b) < V.DEGENERATE_ENTROPY_MAX)
    steady &= (wide(gap_d("ab")) - wide(gap_n("ab"))) * 100 > wide(gap_d("ab")) * V.DEGENERATE_STABILITY_MIN_PCT
    degenerate = _above(steady) & ~((grammar >= 2) & _above(reading))
    dominated = F.when(share.isNotNull(), _above(concentration_pct > share))
    all_ = lambda tests: F.array_min(F.array(*tests))
    tests = {
        "drop_confounded": ~all_(bounds_ok),
        "asymmetric_missingness": ~all_(asym_ok),
        "below_drop_bound": ~above_bound,
        "below_surface_noise": ~above_noise,
        "not_reading": ~reading,
        "degenerate_candidate": degenerate,
        "scenario_dominated": dominated,
    }
    flags = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    unset = F.array_compact(F.array(F.when(theta.isNull(), F.lit("theta_positive_pct")), F.when(share.isNull(), F.lit("scenario_dominated_share_pct"))))
    out = rows.withColumns({"reading": reading, "above_drop_bound": above_bound, "above_surface_noise": above_noise, "dominated": dominated, "flags": flags, "unset": unset})
    return out.withColumn("all_passed", (F.size("flags") == 0) & (F.size("unset") == 0))


def on_curve(status: Column, lane: Column) -> Column:
    return F.col("all_passed") & (status == "admitted") & lane.isin("open", "guard")


def compare(x: str, y: str) -> Column:
    """Verdict on y against x, two structs of stability, interval and bound: null if either lacks a figure.

    The random limits of both combine in quadrature (at least), their systematic bounds add (more than).
    """
    of = lambda s, f: F.col(f"{s}.{f}")
    delta = of(y, "stability_pct") - of(x, "stability_pct")
    half = [(of(s, "ci_high_pct") - of(s, "ci_low_pct")) / 2 for s in (x, y)]
    limit = F.sqrt(half[0] * half[0] + half[1] * half[1])
    clear = (F.abs(delta) >= limit) & (F.abs(delta) > of(x, "bound_pct") + of(y, "bound_pct"))
    return F.when(clear, F.when(delta > 0, "improved").otherwise("regressed")).when(~clear, "flat")


def map_mismatches(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Keys (owner, key) whose value differs, is missing or is unexpected."""
    both = expected.withColumnRenamed("value", "want").join(observed.withColumnRenamed("value", "have"), ["owner", "key"], "full")
    return both.where(~F.col("want").eqNullSafe(F.col("have"))).select("owner", "key", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").otherwise("differs").alias("what"))


def day_status(days: DataFrame) -> DataFrame:
    """day, fingerprint_ok, margin_ok -> flag: both must be known to be well."""
    well = F.coalesce(F.col("fingerprint_ok"), F.lit(False)) & F.coalesce(F.col("margin_ok"), F.lit(False))
    return days.withColumn("flag", F.when(~well, "instrument_suspect"))
