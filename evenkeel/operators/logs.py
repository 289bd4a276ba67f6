"""Append-only logs: replaying events, coverage and gaps, due jobs, spending, alarms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.canonical import row_json
from evenkeel.functions.grammar import funds_error
from evenkeel.functions.hashing import token_cost
from evenkeel.functions.vocabulary import EVENTS_THAT_ADD, EVENTS_THAT_REMOVE
from evenkeel.sources.tables import materialize

#: Gap causes by runner and skip reason; any other pair has no honest cause.
SKIP_CAUSES = {("full_sweep", "budget_halted"): "budget_halted"}
#: Share of the monthly pool from which a rung holds, its name, most protocols, and the one lane it allows.
RUNGS = ((0, "full", 10**9, None), (60, "reduced_sweep", 6, None), (80, "guard_only_sweep", 4, "guard"), (95, "fingerprint_only", 0, None))
#: Why a run that was tried doesn't count, by what it met.
MET = {"ran_today": "already_ran_today", "no_funds": "budget_halted", "circuit_open": "circuit_open"}


def listed_models(log: DataFrame) -> DataFrame:
    """family, model_id whose last membership event added it."""
    events = log.where(F.col("event").isin(*EVENTS_THAT_ADD, *EVENTS_THAT_REMOVE))
    last = events.groupBy("family", "model_id").agg(F.max_by("event", "place").alias("event"))
    return last.where(F.col("event").isin(*EVENTS_THAT_ADD)).select("family", "model_id")


def model_diff(listing: DataFrame, log: DataFrame, active: DataFrame) -> DataFrame:
    """What a listing (family, model_id) changes: baseline, appeared or gone, and whether an active model is gone."""
    seen = listed_models(log).withColumn("seen", F.lit(True))
    known = log.select("family").distinct().withColumn("has_log", F.lit(True))
    both = listing.distinct().withColumn("listed", F.lit(True)).join(seen, ["family", "model_id"], "full").join(known, "family", "left")
    what = F.when(F.col("listed") & F.col("has_log").isNull(), "baseline").when(F.col("listed") & F.col("seen").isNull(), "appeared").when(F.col("seen") & F.col("listed").isNull(), "gone")
    rows = both.withColumn("change", what).where("change is not null")
    in_use = active.select("family", "model_id").distinct().withColumn("is_active", F.lit(True))
    return rows.join(in_use, ["family", "model_id"], "left").select("family", "model_id", "change", (F.coalesce("is_active", F.lit(False)) & (F.col("change") == "gone")).alias("active_gone"))


def owed(log: DataFrame) -> DataFrame:
    """family, model_id, since: appeared, neither gone nor rebased later, never waived."""
    waived = log.where("event = 'bridge_waived'").select("family", "model_id").distinct()
    last = log.where(F.col("event").isin("appeared", "gone", "baseline")).groupBy("family", "model_id").agg(F.max_by(F.struct("event", "day"), "place").alias("e"))
    return last.where("e.event = 'appeared'").select("family", "model_id", F.col("e.day").alias("since")).join(waived, ["family", "model_id"], "left_anti")


def daily(observations: DataFrame) -> DataFrame:
    """day, ran, of: checks that ran, of all."""
    return observations.groupBy("day").agg(F.count_if("ran").alias("ran"), F.count("*").alias("of"))


def missing_causes(observations: DataFrame) -> DataFrame:
    return observations.where(~F.col("ran")).groupBy("cause").agg(F.count("*").alias("gaps"))


def honest_causes(skips: DataFrame) -> DataFrame:
    """runner, day -> cause: known only if exactly one distinct skip reason was seen and is mapped."""
    rows = skips.groupBy("runner", "day").agg(F.count_distinct("reason").alias("reasons"), F.min("reason").alias("reason"))
    cause = None
    for (runner, reason), name in SKIP_CAUSES.items():
        test = (F.col("runner") == runner) & (F.col("reason") == reason)
        cause = F.when(test, name) if cause is None else cause.when(test, name)
    return rows.select("runner", "day", "reasons", F.when(F.col("reasons") == 1, cause).alias("cause"))


def activity(measured: DataFrame, observations: DataFrame, most: int = 30) -> DataFrame:
    """The newest rows of the activity feed: measurements, daily checks, gaps."""
    runs = measured.select(
        F.col("run_date").alias("day"), F.lit(2).alias("order"), F.lit("measured").alias("kind"), F.concat_ws(" · ", "protocol_id", "model_id").alias("what"),
        F.format_string("stability %.1f%%", "stability_pct").alias("result"), F.when(F.col("on_curve"), "on").otherwise("off").alias("tone"),
    )
    checks = daily(observations).where("ran > 0").select("day", F.lit(1).alias("order"), F.lit("checks").alias("kind"), F.lit("scheduled checks").alias("what"), F.concat(F.col("ran").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit(" ran")).alias("result"), F.lit(None).cast("string").alias("tone"))
    gaps = observations.where(~F.col("ran")).select("day", F.lit(1).alias("order"), F.lit("gap").alias("kind"), F.col("job").alias("what"), F.concat(F.lit("cause: "), F.col("cause")).alias("result"), F.lit("gap").alias("tone"))
    feed = runs.unionByName(checks).unionByName(gaps)
    return feed.orderBy(F.desc("day"), F.desc("order"), F.desc("what"), F.desc("result"), F.desc("tone")).limit(most).drop("order")


def due(intervals: DataFrame, last_runs: DataFrame, today: Column) -> DataFrame:
    """job, interval_days, last_run, elapsed_days, due: a job that never ran is due."""
    rows = intervals.join(last_runs, "job", "left").withColumn("elapsed_days", F.datediff(today, F.col("last_run")))
    return rows.withColumn("due", F.col("last_run").isNull() | (F.col("elapsed_days") >= F.col("interval_days")))


def routed(due_jobs: DataFrame, runners: DataFrame) -> DataFrame:
    """runner -> its due jobs, comma-joined in order; jobs of no runner are left out."""
    return due_jobs.where("due").join(runners, "job").groupBy("runner").agg(F.array_join(F.array_sort(F.collect_set("job")), ",").alias("jobs"))


def month_ledger(ledger: DataFrame) -> DataFrame:
    """month: entries and exact amounts, measured ones apart from billed ones."""
    auto = F.contains(F.col("note"), F.lit("not yet reconciled"))
    return ledger.groupBy(F.date_format("run_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("entries"), F.count_if(auto).alias("auto_entries"), F.sum("amount").alias("total"), F.coalesce(F.sum(F.when(auto, F.col("amount"))), F.lit(0).cast("decimal(30,2)")).alias("auto_total")
    )


def rung(spent: Column, ceiling: Column) -> Column:
    """The rung that holds at this spending, as a struct of name, most and lane."""
    found = None
    for least, name, most, lane in sorted(RUNGS, reverse=True, key=lambda r: r[0]):
        value = F.struct(F.lit(name).alias("name"), F.lit(most).alias("most"), F.lit(lane).cast("string").alias("lane"))
        test = spent * 100 >= ceiling * least
        found = F.when(test, value) if found is None else found.when(test, value)
    return found


def rung_at(spent: int | None, ceiling: int | None) -> tuple[str | None, int | None, str | None]:
    """`rung` of two values: name, most and lane."""
    if spent is not None and ceiling is not None:
        for least, name, most, lane in sorted(RUNGS, reverse=True, key=lambda r: r[0]):
            if spent * 100 >= ceiling * least:
                return name, most, lane
    return None, None, None


def error_runs(calls: DataFrame, by: list[str], order: str, least: int = 5) -> DataFrame:
    """Runs of `least` or more consecutive failed calls: by, first, last, length.

    Calls are sorted over all tasks, so a client of any size lies in many pieces. Runs are found
    inside each piece; those that touch its first or last call, two a piece at most, are
    carried on into the neighbouring pieces.
    """
    at = {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}
    ranked = materialize(calls.select(*by, order, "failed").orderBy(*by, order).withColumns(at), "calls-ranked")
    piece = Window.partitionBy(*by, "_part")
    block = F.count_if(~F.col("failed")).over(piece.orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    marked = ranked.withColumns({"_block": block, "_a": F.min("_row").over(piece), "_b": F.max("_row").over(piece)}).where("failed")
    runs = marked.groupBy(*by, "_part", "_block").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"), (F.min("_row") == F.min("_a")).alias("_opens"), (F.max("_row") == F.max("_b")).alias("_closes"))
    pieces = ranked.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_of")).distinct()
    pieces = pieces.withColumn("_no", F.row_number().over(Window.partitionBy(*(f"_{c}" for c in by)).orderBy("_of")))
    mine = F.col("_of") == F.col("_part")
    for c in by:
        mine &= F.col(f"_{c}").eqNullSafe(F.col(c))
    edges = runs.where("_opens or _closes").join(pieces, mine)
    line = Window.partitionBy(*by).orderBy("_no", "_block")
    goes_on = F.col("_opens") & F.lag("_closes", 1, False).over(line) & (F.lag("_no").over(line) == F.col("_no") - 1)
    edges = edges.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    edges = edges.withColumn("_run", F.count_if(~F.col("_on")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edges.groupBy(*by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length")).drop("_run")
    inner = runs.where("not (_opens or _closes)").select(*by, "first", "last", "length")
    return inner.unionByName(whole).where(F.col("length") >= least)


# Answers that end a run at once, and failed calls in a row that do.
FATAL_STATUSES, MOST_FAILURES = (401, 403, 404), 5


def call_faults() -> Column:
    """What ends a run at one failed call (funded out, or a fatal status), from status and message; else null."""
    return F.when(funds_error(F.col("status"), F.col("message")), "funds").when(F.col("status").isin(*FATAL_STATUSES), "status")


def run_stops(calls: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, stopped_at, why of every run that its breaker ends: spent funds, a fatal status, or too many failed calls in a row.

    calls: failed, status and message of each call; a run's calls are numbered by `order`.
    """
    line = Window.partitionBy(*by).orderBy(order)
    block = F.count_if(~F.col("failed")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    streak = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order)) - F.when(F.col("_block") > 0, 1).otherwise(0)
    why = F.coalesce(call_faults(), F.when(F.col("_streak") >= MOST_FAILURES, "failures"))
    marked = calls.withColumn("_block", block).withColumn("_streak", streak).where("failed").withColumn("why", why).where("why is not null")
    return marked.groupBy(*by).agg(F.min(order).alias("stopped_at"), F.min_by("why", order).alias("why"))


def silences(rows: DataFrame, by: str, at: str, hours: int) -> DataFrame:
    """by, last, silent_at: each time that nothing came for more than `hours` hours, up to the last line of the whole log."""
    line = Window.partitionBy(by).orderBy(at)
    nexts = rows.select(by, F.col(at).alias("last"), F.lead(at).over(line).alias("next"))
    end = rows.agg(F.max(at)).first()[0]
    silent = F.col("last") + F.make_dt_interval(hours=F.lit(hours))
    return nexts.where(silent < F.coalesce("next", F.lit(end))).select(by, "last", silent.alias("silent_at"))


def alarms_since(alarms: DataFrame, today: Column, days: int) -> DataFrame:
    """Distinct days with a line that isn't ok, among the last `days` days, today included."""
    return alarms.where(~F.col("ok") & F.col("run_date").between(F.date_sub(today, days - 1), today)).select("run_date").distinct()


def liveness(commits: DataFrame, by: str, now: Column, hours: int) -> DataFrame:
    """by, silent_hours, alive: how long since the last line; none at all is silent."""
    rows = commits.groupBy(by).agg(F.max("ts").alias("last"))
    silent = (F.unix_timestamp(now) - F.unix_timestamp("last")) / 3600
    return rows.select(by, F.round(silent, 1).alias("silent_hours"), F.coalesce(silent <= hours, F.lit(False)).alias("alive"))


def baselines(rows: DataFrame, by: str) -> DataFrame:
    """Each row with the first figure of its line, by day and place: the line's baseline."""
    first = F.first("value").over(Window.partitionBy(by).orderBy("day", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("baseline", first)


def latest_state(states: DataFrame) -> DataFrame:
    """job, last_run: the last recorded run of each job."""
    return states.where("ran").groupBy("job").agg(F.max("day").alias("last_run"))


def admit(sweeps: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Which protocols of each sweep run, and why the others don't: the rows with skipped, rung and funds_exhausted.

    Rows hold already_run, preregistered, lane, cost, spent (before the sweep) and ceiling; and,
    if known, met (what a run met: ran_today, no_funds, circuit_open) and actual (what it cost).
    Reasons in this order: already_run_this_month, not_preregistered, budget_halted by the
    rung, by its lane or by the ceiling, then what the run met. A sweep ends where funds are out
    or the circuit opens; rows beyond are not_reached. The rung depends on what the protocols
    before cost, so a sweep is gone through in order (rows equal in `order` by their other
    columns), in one sorted stream that keeps its last state and nothing else; sweeps are
    independent of each other.
    """
    schema = T.StructType([*sweeps.schema, T.StructField("skipped", T.StringType()), T.StructField("rung", T.StringType()), T.StructField("funds_exhausted", T.BooleanType())])
    given = ("already_run", "preregistered", "lane", "cost", "spent", "ceiling", "met", "actual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ran, projected, stopped = None, 0, 0, False
        for batch in batches:
            n = batch.num_rows
            columns = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * n for c in given]
            told = []
            for sweep, row in zip(zip(*(batch.column(c).to_pylist() for c in by)), zip(*columns)):
                if sweep != of:
                    of, ran, projected, stopped = sweep, 0, 0, False
                already, registered, lane, cost, spent, ceiling, met, actual = row
                total = None if spent is None or projected is None else spent + projected
                name, most, only = rung_at(total, ceiling)
                reason = None
                if stopped:
                    reason = "not_reached"
                elif already:
                    reason = "already_run_this_month"
                elif registered is False:
                    reason = "not_preregistered"
                elif (most is not None and ran >= most) or (only is not None and lane != only) or (None not in (total, cost, ceiling) and total + cost > ceiling):
                    reason = "budget_halted"
                tried = reason is None
                if tried:
                    reason = MET.get(met)
                told.append((reason, None if stopped else name, tried and met == "no_funds"))
                if reason is None:
                    ran += 1
                    paid = cost if actual is None else actual
                    projected = None if projected is None or paid is None else projected + paid
                stopped = stopped or (tried and met in ("no_funds", "circuit_open"))
            skipped, names, funds = zip(*told) if told else ((), (), ())
            made = [pa.array(skipped, pa.string()), pa.array(names, pa.string()), pa.array(funds, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *schema.names[-3:]])

    rest = [c for c in sweeps.columns if c not in by and c not in order]
    return sweeps.repartition(*by).sortWithinPartitions(*by, *order, *rest).mapInArrow(run, schema)


def registry_events(diff: DataFrame, today: Column) -> DataFrame:
    """family, model_id, line (the record to append) and bridge_needed of each change of a listing."""
    rows = diff.select("family", "model_id", "change", F.lit("model_observed").alias("record_type"), today.cast("string").alias("observed_date"), F.col("change").alias("event"))
    line = row_json(rows.schema, "record_type", "observed_date", "family", "model_id", "event")
    return rows.select("family", "model_id", line.alias("line"), (F.col("change") == "appeared").alias("bridge_needed"))


def listing_verdicts(diff: DataFrame, plan: DataFrame, spent: DataFrame, reserves: DataFrame, cost_per_call: str) -> DataFrame:
    """family, n_events, new_model (the first that appeared), and for a family with one: calls_total, cost and whether its bridge fits the reserve.

    diff: family, model_id, change; plan: one row of `protocols.plan_bridge`; spent: one row with
    this month's bridge spending; reserves: family, reserve. Amounts are exact decimals.
    """
    events = diff.groupBy("family").agg(F.count("*").alias("n_events"), F.min(F.when(F.col("change") == "appeared", F.col("model_id"))).alias("new_model"))
    one = plan.select("calls_total", F.lit(1).alias("_one")).join(spent.select(F.col("spent").cast("decimal(20,2)").alias("spent"), F.lit(1).alias("_one")), "_one")
    rows = events.join(reserves, "family", "left").withColumn("_one", F.when(F.col("new_model").isNotNull(), 1)).join(F.broadcast(one), "_one", "left")
    cost = (F.col("calls_total").cast("decimal(18,0)") * F.lit(cost_per_call).cast("decimal(10,4)")).cast("decimal(24,4)")
    return rows.select("family", "n_events", "new_model", "calls_total", cost.alias("cost"), (F.col("spent") + cost <= F.col("reserve")).alias("allowed"))


def spend_entries(runs: DataFrame) -> DataFrame:
    """Ledger entries of finished runs, from the tokens they used; an unknown price or no cost writes nothing."""
    note = F.concat("category", F.lit("; tokens x list price ("), F.col("tokens_in").cast("string"), F.lit(" in / "), F.col("tokens_out").cast("string"), F.lit(" out), not yet reconciled"))
    priced = runs.withColumn("amount", token_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))
    return priced.where("amount > 0").select("run_id", "category", "amount", note.alias("note"))


def bridge_steps(complete: DataFrame, generations: DataFrame, ledger: DataFrame, sweeps: DataFrame) -> DataFrame:
    """What is left to do after a bridge has run: new_model, protocol_id, month, listed, billed, gap_logged, open_required.

    complete: new_model, protocol_id, month. An item stays while the model isn't listed or
    the month has no bill; the sweep's gap is a reminder only.
    """
    named = generations.select("new_model", F.lit(True).alias("listed")).distinct()
    bills = ledger.where("category = 'bridge'").groupBy(F.date_format("run_date", "yyyy-MM").alias("month")).agg((F.sum("amount") > 0).alias("billed"))
    gaps = sweeps.select("month", F.lit(True).alias("gap_logged")).distinct()
    rows = complete.join(named, "new_model", "left").join(bills, "month", "left").join(gaps, "month", "left")
    rows = rows.select("new_model", "protocol_id", "month", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("listed", "billed", "gap_logged")))
    return rows.withColumn("open_required", (~F.col("listed")).cast("int") + (~F.col("billed")).cast("int")).where("open_required > 0")
