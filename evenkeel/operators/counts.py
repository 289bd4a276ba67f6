"""Conditional counts of a run's trials, and the exact statistics that follow from them.

One grouped pass over the trials yields a row for each group with, for each version, the
calls, the valid ones, and the counts of the options in declared order. Everything else
is an expression over that row, so a run costs one partially aggregated shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.exact import published, wide
from evenkeel.functions.vocabulary import OUTCOMES, PAIRS, VALID, VERSIONS

OPTIONS = ["A", "B"]


def tally(trials: DataFrame, by: list[str], options: list[str] = OPTIONS) -> DataFrame:
    """by, n_<version>, valid_<version>, c_<version> (counts by option); an undeclared token is an error."""
    known = F.col("token").isin(*options) | F.col("token").isNull()
    token = F.when(known, F.col("token")).otherwise(F.raise_error(F.concat(F.lit("undeclared token: "), F.col("token"))))
    rows = trials.select(*by, "version", "outcome", token.alias("token"))
    measures = []
    for v in VERSIONS:
        here = F.col("version") == v
        good = here & (F.col("outcome") == VALID)
        measures += [F.count_if(here).alias(f"n_{v}"), F.count_if(good).alias(f"valid_{v}")]
        measures.append(F.array(*(F.count_if(good & (F.col("token") == o)) for o in options)).alias(f"c_{v}"))
    return rows.groupBy(*by).agg(*measures)


def added(cells: DataFrame, by: list[str], options: list[str] = OPTIONS) -> DataFrame:
    """Rows of `tally` over finer groups, added up to the groups of `by`."""
    measures = []
    for v in VERSIONS:
        measures += [F.sum(f"n_{v}").alias(f"n_{v}"), F.sum(f"valid_{v}").alias(f"valid_{v}")]
        measures.append(F.array(*(F.sum(F.col(f"c_{v}")[k]) for k in range(len(options)))).alias(f"c_{v}"))
    return cells.groupBy(*by).agg(*measures)


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(x: Column, y: Column) -> tuple[Column, Column]:
    """Total variation distance of two count arrays as numerator and denominator; null if a side is empty."""
    nx, ny = total(x), total(y)
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(wide(a) * wide(ny) - wide(b) * wide(nx))), F.lit(0).cast("decimal(38,0)"), lambda s, d: (s + d).cast("decimal(38,0)"))
    some = (nx > 0) & (ny > 0)
    return F.when(some, apart), F.when(some, (wide(nx) * wide(ny) * 2).cast("decimal(38,0)"))


def entropy(counts: Column, k: int) -> Column:
    """Shannon entropy to the base k; null for no responses or fewer than two options."""
    if k < 2:
        return F.lit(None).cast("double")
    n = total(counts).cast("double")
    some = F.filter(counts, lambda x: x > 0)
    nats = F.aggregate(some, F.lit(0.0), lambda s, x: s + x / n * F.log(x / n))
    return F.when(n > 0, -nats / F.log(F.lit(float(k))))


def with_pairs(rows: DataFrame) -> DataFrame:
    """Adds, for each pair: gap_num, gap_den; bound_num, asym_num, loss_den (percent is 100 * num / den)."""
    for p, (x, y) in PAIRS.items():
        num, den = distance(F.col(f"c_{x}"), F.col(f"c_{y}"))
        nx, ny = wide(F.col(f"n_{x}")), wide(F.col(f"n_{y}"))
        lost_x, lost_y = nx - wide(F.col(f"valid_{x}")), ny - wide(F.col(f"valid_{y}"))
        rows = rows.withColumns({
            f"gap_num_{p}": num,
            f"gap_den_{p}": den,
            f"bound_num_{p}": (lost_x * ny + lost_y * nx).cast("decimal(38,0)"),
            f"asym_num_{p}": F.abs(lost_x * ny - lost_y * nx).cast("decimal(38,0)"),
            f"loss_den_{p}": (nx * ny).cast("decimal(38,0)"),
        })
    return rows


def percent(rows: DataFrame, what: str, pair: str) -> Column:
    den = "gap_den" if what == "gap" else "loss_den"
    return published(F.col(f"{what}_num_{pair}") * 100, F.col(f"{den}_{pair}"))


def stability(pair: str = "ab") -> Column:
    """100 - gap, published from the exact value."""
    num, den = F.col(f"gap_num_{pair}"), F.col(f"gap_den_{pair}")
    return published((den - num) * 100, den)


def tvd_stability(trials: DataFrame) -> DataFrame:
    rows = with_pairs(tally(trials, ["run_id"]))
    return rows.select("run_id", *(percent(rows, "gap", p).alias(f"gap_pct_{p}") for p in PAIRS), stability().alias("stability_pct"))


def option_counts(trials: DataFrame, options: list[str] = OPTIONS) -> DataFrame:
    """Dense grid run x version x option, zero-filled."""
    rows = tally(trials, ["run_id"], options)
    cells = [F.struct(F.lit(v).alias("version"), F.lit(o).alias("option"), F.get(F.col(f"c_{v}"), F.lit(i)).alias("n")) for v in VERSIONS for i, o in enumerate(options)]
    return rows.select("run_id", F.explode(F.array(*cells)).alias("g")).select("run_id", "g.*")


def loss_bounds(trials: DataFrame) -> DataFrame:
    rows = with_pairs(tally(trials, ["run_id"]))
    rates = (published(F.col(f"n_{v}") - F.col(f"valid_{v}"), F.col(f"n_{v}")).alias(f"u_{v.lower()}") for v in VERSIONS)
    pairs = (percent(rows, w, p).alias(f"{name}_{p}") for w, name in (("bound", "drop_bound_pct"), ("asym", "drop_asymmetry_pct")) for p in PAIRS)
    return rows.select("run_id", *rates, *pairs)


def entropies(trials: DataFrame, options: list[str] = OPTIONS) -> DataFrame:
    rows = tally(trials, ["run_id"], options)
    return rows.select("run_id", *(F.round(entropy(F.col(f"c_{v}"), len(options)), 6).alias(f"entropy_{v.lower()}") for v in VERSIONS))


def outcome_histogram(trials: DataFrame) -> DataFrame:
    """run_id, version and a zero-filled column for each outcome."""
    return trials.groupBy("run_id", "version").agg(*(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES))


def outcome_rows(trials: DataFrame) -> DataFrame:
    """run_id, version, outcome, count in long form, zeros included."""
    wide_ = outcome_histogram(trials)
    return wide_.unpivot(["run_id", "version"], [f"n_{o}" for o in OUTCOMES], "name", "count").select("run_id", "version", F.substr("name", F.lit(3)).alias("outcome"), "count")


def valid_share(trials: DataFrame) -> DataFrame:
    rows = trials.groupBy("run_id", "version").agg(F.count_if(F.col("outcome") == VALID).alias("valid"), F.count("*").alias("calls"))
    return rows.select("run_id", "version", published(F.col("valid"), F.col("calls")).alias("valid_share"))


def decision_table(trials: DataFrame, options: list[str] = OPTIONS) -> DataFrame:
    """run_id, version and a column for each token, zero-filled."""
    table = trials.where(F.col("outcome") == VALID).groupBy("run_id", "version").pivot("token", options).count()
    return table.select("run_id", "version", *(F.coalesce(F.col(o), F.lit(0)).alias(f"decided_{o.lower()}") for o in options))


def lost_replies(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("outcome") != VALID).groupBy("outcome").agg(F.count("*").alias("lost"), F.count_distinct("run_id").alias("runs"))


def changed_decisions(trials: DataFrame, options: list[str] = OPTIONS) -> DataFrame:
    """Per run: scenarios whose majority token is defined under A and B, and those where it differs."""
    rows = tally(trials, ["run_id", "scenario_id"], options)

    def major(counts: Column) -> Column:
        best = F.array_max(counts)
        alone = F.size(F.filter(counts, lambda x: x == best)) == 1
        return F.when((best > 0) & alone, F.array_position(counts, best))

    said = rows.select("run_id", major(F.col("c_A")).alias("a"), major(F.col("c_B")).alias("b"))
    return said.groupBy("run_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("measurable"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def tokens_seen(trials: DataFrame) -> DataFrame:
    """Distinct values of a column in sorted, comma-joined form, null if there are none."""
    joined = F.array_join(F.array_sort(F.collect_set("token")), ",")
    return trials.groupBy("run_id", "version").agg(F.nullif(joined, F.lit("")).alias("tokens"))
