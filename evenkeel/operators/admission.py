"""Admission of a protocol: every structural rule it must keep before it may be run, and its hashes.

Rows hold one protocol: the fields of `REQUIRED`, with `options` an array of strings and
`scenarios` an array of structs (scenario_id, options, versions: struct of the four version
texts, broken: names of structure rules that the scenario's declared lotteries break, null
if it declares none). Panels are short, so scenarios are looked at inside their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import hashing as S
from evenkeel.functions.canonical import json_text
from evenkeel.functions.grammar import option_keys, surface_skeleton
from evenkeel.functions.vocabulary import VERSIONS
from evenkeel.operators.protocols import lane_tests, reasons

# Fields that a protocol must have, those of them that may be null, and fields that its hash covers.
REQUIRED = ["protocol_id", "family", "rewording_type", "status", "lane", "twin_id", "n", "n_per_scenario", "effort", "grammar_version", "options", "prompt_template", "theta_positive_pct", "scenario_dominated_share_pct", "scenarios", "panel_sha256", "protocol_sha256"]
MAY_BE_NULL = ["lane", "twin_id", "theta_positive_pct", "scenario_dominated_share_pct"]
HASHED = ["family", "rewording_type", "n", "n_per_scenario", "effort", "grammar_version", "options", "prompt_template", "theta_positive_pct", "scenario_dominated_share_pct", "panel_sha256"]
GRAMMAR_VERSIONS = (1, 2)


def panel_sha256(scenarios: Column) -> Column:
    """Hash of what a model sees of the scenarios: options, ids and version texts."""
    seen = F.transform(scenarios, lambda s: F.struct(s["options"].alias("options"), s["scenario_id"].alias("scenario_id"), F.struct(*(s["versions"][v].alias(v) for v in sorted(VERSIONS))).alias("versions")))
    text = T.StringType()
    versions = T.StructType([T.StructField(v, text) for v in VERSIONS])
    return S.sha256(json_text(seen, T.ArrayType(T.StructType([T.StructField("options", T.ArrayType(text)), T.StructField("scenario_id", text), T.StructField("versions", versions)]))))


def protocol_sha256(schema: T.StructType) -> Column:
    """Hash of the fields that a protocol is known by, of rows with the given schema."""
    return S.row_sha256(schema, *HASHED)


def _of_scenarios(name: str, test) -> Column:
    """name:id of the scenarios for which the test holds."""
    return F.transform(F.filter("scenarios", lambda s: F.coalesce(test(s), F.lit(True))), lambda s: F.concat(F.lit(f"{name}:"), s["scenario_id"]))


def broken_rules(protocols: DataFrame) -> DataFrame:
    """place, broken (names of the protocol's broken rules), scenario_faults (rule:scenario), both empty if it may be admitted."""
    c = F.col
    missing = F.array_compact(F.array(*(F.when(c(x).isNull(), F.lit(x)) for x in REQUIRED if x not in MAY_BE_NULL)))
    keys = option_keys(c("options"))
    ids = F.transform("scenarios", lambda s: s["scenario_id"])
    of_protocol = reasons(
        **lane_tests(c("twin_id"), c("protocol_id")),
        unknown_grammar=~c("grammar_version").isin(*GRAMMAR_VERSIONS),
        effort_not_disabled=c("effort") != "disabled",
        no_placeholder=~F.contains(c("prompt_template"), F.lit("{scenario}")),
        options_collide=F.size(F.array_distinct(keys)) != F.size("options"),
        duplicate_scenario=F.size(F.array_distinct(ids)) != F.size("scenarios"),
        wrong_n=c("n") != c("n_per_scenario") * F.size("scenarios"),
        panel_hash=c("panel_sha256") != panel_sha256(c("scenarios")),
        protocol_hash=c("protocol_sha256") != protocol_sha256(protocols.schema),
    )
    text = lambda s, v: s["versions"][v]
    whole = lambda s: s["versions"].isNotNull() & F.forall(F.array(*(text(s, v) for v in VERSIONS)), lambda t: t.isNotNull())
    tests = {
        "other_options": lambda s: s["options"] != c("options"),
        "versions_missing": lambda s: ~whole(s),
        "empty_version": lambda s: whole(s) & F.exists(F.array(*(text(s, v) for v in VERSIONS)), lambda t: F.regexp_replace(t, r"(?U)\s+", "") == ""),
        "null_change_too_large": lambda s: whole(s) & (surface_skeleton(text(s, "A")) != surface_skeleton(text(s, "A_prime"))),
        "null_change_missing": lambda s: whole(s) & (text(s, "A") == text(s, "A_prime")),
        "no_structure": lambda s: whole(s) & s["broken"].isNull(),
    }
    found = [_of_scenarios(name, test) for name, test in tests.items()]
    structure = F.flatten(F.transform("scenarios", lambda s: F.transform(F.coalesce(s["broken"], F.array().cast("array<string>")), lambda rule: F.concat(rule, F.lit(":"), s["scenario_id"]))))
    faults = F.array_sort(F.concat(*found, structure))
    none = F.array().cast("array<string>")
    lacking = F.size(missing) > 0
    return protocols.select(
        "place",
        F.when(lacking, F.transform(missing, lambda x: F.concat(F.lit("missing "), x))).otherwise(of_protocol).alias("broken"),
        F.when(lacking, none).otherwise(faults).alias("scenario_faults"),
    )


def promote(protocols: DataFrame, lane: Column, twin_id: Column) -> DataFrame:
    """place, outcome of promoting each protocol to a lane: only candidates may be, and every rule must hold before and after."""
    asked = protocols.withColumns({"_lane": lane, "_twin": twin_id}).withColumn("_after", F.explode(F.array(F.lit(False), F.lit(True))))
    key = F.struct("place", F.col("status").alias("was"), F.col("_lane").alias("lane"), F.col("_after").alias("after"))
    changed = {"place": key, "status": F.when(F.col("_after"), "admitted").otherwise(F.col("status")), "lane": F.when(F.col("_after"), F.col("_lane")).otherwise(F.col("lane")), "twin_id": F.when(F.col("_after"), F.col("_twin")).otherwise(F.col("twin_id"))}
    found = broken_rules(asked.select(*(changed[c].alias(c) if c in changed else c for c in protocols.columns)))
    fails = (F.size("broken") > 0) | (F.size("scenario_faults") > 0)
    rows = found.groupBy("place.place", "place.was", "place.lane").agg(F.max(fails & ~F.col("place.after")).alias("before"), F.max(fails & F.col("place.after")).alias("after"))
    known = F.coalesce(F.col("lane").isin("open", "guard", "sealed"), F.lit(False))
    outcome = F.when(~F.col("was").eqNullSafe(F.lit("candidate")), "not_candidate").when(~known, "unknown_lane").when(F.col("before"), "fails_before").when(F.col("after"), "fails_after").otherwise("promoted")
    return rows.select("place", outcome.alias("outcome"))
