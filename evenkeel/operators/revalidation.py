"""Re-derivation audit: a kept run is rebuilt from its protocol and its trials, and compared with what was stored.

Four checks. The protocol still has the hash that the run recorded. The seeded order of calls,
rebuilt, gives each trial's call and prompt hash by position. Replies, classified again, give
the stored outcomes. The measurement, counted again from the stored trials, has the stored
fields. What the second and third check need of a run (its order, its prompts' hashes, its
grammar) is one row, which meets the run's trials in one join; all checks fold to one record
a run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import grammar as G
from evenkeel.functions import hashing as S
from evenkeel.functions.vocabulary import VERSIONS
from evenkeel.operators import audit as A
from evenkeel.operators import resampling as R

#: A field that may differ with a note only: which code made a measurement, and not what it says.
CODE = "analysis_code_sha"


def choose(runs: DataFrame, day: Column, most: int) -> DataFrame:
    """The first runs of a day's hash order: the same day always takes the same."""
    return runs.orderBy(S.sample_order(day, F.col("run_id")), "run_id").limit(most)


def _scheduled(runs: DataFrame, protocols: DataFrame, *more: str) -> DataFrame:
    """run_id, n_calls, reps, ids (of scenarios), sent (hashes of prompts by version and scenario), order (of calls) and more columns of the protocol, a row for each run."""
    hashed = lambda v: F.transform("scenarios", lambda s: F.unhex(S.sha256(G.prompt(F.col("prompt_template"), s["versions"][v]))))
    sent = F.concat(*(hashed(v) for v in VERSIONS))  # a prompt is rendered and hashed once for each version and scenario of a protocol
    reps = F.col("n_per_scenario").cast("long")
    one = protocols.select("protocol_id", reps.alias("reps"), (reps * F.size("scenarios") * len(VERSIONS)).alias("n_calls"), F.transform("scenarios", lambda s: s["scenario_id"]).alias("ids"), sent.alias("sent"), *more)
    seed = S.seed(F.col("protocol_id"), F.col("day").cast("string"), F.col("model_id"), F.lit("order"))
    return R.ordered(runs.join(one, "protocol_id").select("run_id", "n_calls", "reps", "ids", "sent", *more, seed.alias("seed"))).drop("seed")


def _told(call: Column) -> list[Column]:
    """version, scenario_id, rep, prompt_sha256 of a call by its number."""
    many, reps = F.size("ids"), F.col("reps")
    named = F.get(F.array(*map(F.lit, VERSIONS)), F.floor(call / (many * reps)).cast("int"))
    scenario = F.get(F.col("ids"), (F.floor(call / reps) % many).cast("int"))
    sha = F.lower(F.hex(F.get(F.col("sent"), F.floor(call / reps).cast("int"))))  # hashes lie version after version
    return [named.alias("version"), scenario.alias("scenario_id"), (call % reps).alias("rep"), sha.alias("prompt_sha256")]


def calls(runs: DataFrame, protocols: DataFrame) -> DataFrame:
    """run_id, index, version, scenario_id, rep, prompt_sha256 of every call, in the seeded order that the run was made in.

    runs: run_id, protocol_id, day, model_id; protocols: protocol_id, prompt_template,
    n_per_scenario, scenarios (structs of scenario_id and versions, a struct of texts).
    """
    made = _scheduled(runs, protocols).select("run_id", "reps", "ids", "sent", F.posexplode("order").alias("index", "call"))
    return made.select("run_id", F.col("index").cast("long").alias("index"), *_told(F.col("call")))


def _in_order(trials: DataFrame, runs: DataFrame, protocols: DataFrame) -> DataFrame:
    """run_id, n_kept, parts (twice the place where the kept trials first part from the schedule, and one more if only the hash differs there) and changed (trials whose stored outcome, token or reason a fresh classification doesn't give; those of `_other_texts` apart).

    Trials are put in order inside their run and meet the run's schedule by position. One that
    is kept twice or lost moves those behind it, so its place is the lesser of index and position.
    """
    stored = F.struct("outcome", "token", "reason")
    early = G.early()
    asked = early.isNull() & G.plain()  # replies are read before the shuffle: what they state is all that goes on
    done = F.when(early.isNotNull(), ~early.eqNullSafe(stored)).when(~G.plain(), False)
    read = trials.select("run_id", "index", "version", "scenario_id", "rep", "prompt_sha256", "outcome", "token", "reason", done.alias("done"), F.when(asked, G.native_stated(F.col("text"))).alias("stated"), F.when(asked, G.native_tails(F.col("text"))).alias("tails"))
    kept = read.withColumn("at", F.row_number().over(Window.partitionBy("run_id").orderBy("index")) - 1)

    keys = G.option_keys(F.col("options"))
    unlike = F.when(F.size(F.array_distinct(keys)) != F.size("options"), F.raise_error(F.concat(F.lit("two options read alike: "), F.array_join("options", ", ")))).otherwise(keys)
    about = _scheduled(runs, protocols.withColumn("keys", unlike), "options", "keys", "grammar_version")
    both = kept.join(about.withColumnsRenamed({"run_id": "run", "order": "call_of"}), F.col("run_id") == F.col("run"))
    want = F.struct(*_told(F.get(F.col("call_of"), F.col("at")).cast("long")))
    known = F.filter("tails", lambda t: F.array_contains("keys", t))
    rows = both.select("run_id", "index", "at", F.struct("version", "scenario_id", "rep").alias("call"), "prompt_sha256", want.alias("want"), stored.alias("stored"), "done", "stated", "tails", known.alias("known"), "keys", "options", "grammar_version")
    fresh = G.verdict(F.col("stated"), F.col("tails"), F.col("known"), F.col("keys"), F.col("options"), F.col("grammar_version"))
    judged = F.col("options").isNotNull() & F.col("grammar_version").isNotNull()
    same_call = F.col("at").eqNullSafe(F.col("index")) & F.col("call").eqNullSafe(F.struct("want.version", "want.scenario_id", "want.rep"))
    place = F.least(F.col("index"), F.col("at").cast("long")) * 2
    parts = F.when(~same_call, place).when(~F.col("want.prompt_sha256").eqNullSafe(F.col("prompt_sha256")), place + 1)
    rows = rows.select("run_id", parts.alias("parts"), F.when(judged, F.coalesce("done", ~fresh.eqNullSafe(F.col("stored")))).alias("changed"))
    return rows.groupBy("run_id").agg(F.count("*").alias("n_kept"), F.min("parts").alias("parts"), F.count_if("changed").alias("changed"))


def _other_texts(trials: DataFrame, runs: DataFrame, protocols: DataFrame) -> DataFrame:
    """run_id, changed_other: the same of replies beyond plain text, which the grammar reads by its exact rule."""

    @F.pandas_udf(G.RESULT)
    def exact(texts: pd.Series, options: pd.Series, version: pd.Series) -> pd.DataFrame:
        texts = texts.reset_index(drop=True)
        grammars = pd.Series([(tuple(o), int(v)) for o, v in zip(options, version)], dtype=object)
        found = [G.exact_extract(part, list(k[0]), k[1]).set_index(part.index) for k, part in texts.groupby(grammars)]
        return pd.concat(found).sort_index()

    asked = protocols.select("protocol_id", "options", "grammar_version").where("options is not null and grammar_version is not null")
    odd = trials.where(G.early().isNull() & ~G.plain()).select("run_id", "text", F.struct("outcome", "token", "reason").alias("stored"))
    rows = odd.join(runs.select("run_id", "protocol_id").join(asked, "protocol_id"), "run_id").select("run_id", "stored", exact("text", "options", "grammar_version").alias("fresh"))
    return rows.groupBy("run_id").agg(F.count_if(~F.col("fresh").eqNullSafe(F.col("stored"))).alias("changed_other"))


def audit(runs: DataFrame, protocols: DataFrame, trials: DataFrame, stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """run_id, ok, problems, notes of every run in runs (run_id, day, protocol_id, model_id, protocol_sha256 as recorded).

    trials: run_id, index, version, scenario_id, rep, prompt_sha256, text, error, stop_reason,
    outcome, token, reason; stored and rebuilt: run_id and the measurement's fields. A run
    whose protocol is gone has that problem alone.
    """
    n_calls = F.col("n_per_scenario").cast("long") * F.size("scenarios") * len(VERSIONS)
    now = protocols.select("protocol_id", F.col("protocol_sha256").alias("now_sha256"), F.lit(True).alias("known"), n_calls.alias("n_calls"))
    rows = runs.join(now, "protocol_id", "left")
    differs = A.field_diff(stored, rebuilt, ["run_id"]).select("run_id", F.array_sort("differs").alias("differs"))
    for found in (_in_order(trials, runs, protocols), _other_texts(trials, runs, protocols), differs):
        rows = rows.join(found, "run_id", "left")
    kept = F.coalesce("n_kept", F.lit(0))
    count = F.concat(F.lit("count "), F.col("n_calls").cast("string"), F.lit("/"), kept.cast("string"))
    prompts = F.when(F.col("n_calls") != kept, count).otherwise(F.concat(F.when(F.col("parts") % 2 == 0, "call ").otherwise("hash "), F.floor(F.col("parts") / 2).cast("string")))
    rows = rows.withColumns({"prompts": prompts, "changed": F.coalesce("changed", F.lit(0)) + F.coalesce("changed_other", F.lit(0))})
    none = F.array().cast("array<string>")
    fields = F.coalesce(F.col("differs"), F.array(F.lit("not_stored")))
    only_code = F.coalesce(F.col("differs") == F.array(F.lit(CODE)), F.lit(False))
    problems = F.array_compact(F.array(
        F.when(~F.col("protocol_sha256").eqNullSafe(F.col("now_sha256")), "protocol_hash: differs"),
        F.when(F.col("prompts").isNotNull(), F.concat(F.lit("prompts: "), F.col("prompts"))),
        F.when(F.col("changed") > 0, F.concat(F.lit("classification: "), F.col("changed").cast("string"))),
        F.when((F.size(fields) > 0) & ~only_code, F.concat(F.lit("measurement: "), F.array_join(fields, ", "))),
    ))
    told = F.when(F.col("known").isNull(), F.array(F.lit("protocol_hash: missing"))).otherwise(problems)
    notes = F.when(only_code & F.col("known").isNotNull(), F.array(F.lit(CODE))).otherwise(none)
    return rows.select("run_id", (F.size(told) == 0).alias("ok"), told.alias("problems"), notes.alias("notes"))
