"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are summed into cells (source, language, topic) of tokens. Raking scales the cells'
weights to the target marginals in turn, source, language and topic, under the bound that no
cell gives more tokens than it has: a cell's tokens in the sample are the lesser of its weight
and its tokens, and the cells of a name are scaled by the one factor at which these add up to
the name's share of `budget` of all tokens. Rounds go on until every marginal is within
`TOLERANCE`. A cell's probability is its tokens in the sample over its counted tokens, and a
hash of doc_id decides.

A name that has fewer tokens than its share is kept whole and the other names of its
dimension share what it lacks; a warning names it. Where no sample meets all marginals at
once the budget and the topics hold after the last round, and a warning tells the gap.
`marginals` lists goals, attainable goals and expected tokens.

Targets: a marginal's share is its token share to the power `temper`, made to sum to one;
explicit targets may be given instead. Topic is a property of the text: `tabular` (a bar
between words), `licensed` (names a license), `long` (2,000 words or more) or `prose`.

Cells are the product of three small vocabularies, already summed, so a hot source is one
row, and every round runs over this table of cells alone. Only DataFrame functions are used.

Defined results. Null source or lang is the empty name; a null text has no tokens and
counts as one token, so that every row lies in a cell of positive weight. Rows with equal
doc_id share the decision; a null doc_id is hashed as the empty string. Extra columns are
ignored, or kept by `sample`.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.sources.tables import materialize

DIMENSIONS = ("source", "lang", "topic")
TEMPER, BUDGET = 0.7, 0.5
#: Cells that may be broadcast; more are joined by shuffle.
MOST_BROADCAST = 20_000
#: Gap of a marginal, as a share of the sampled tokens, at which raking ends; rounds after which it gives up; rounds between two looks.
TOLERANCE, MOST_ROUNDS, STRIDE = 1e-9, 600, 6
#: Rounds of the SQL form.
SQL_ROUNDS = 24


def n_tokens(text: Column) -> Column:
    """Words, by the spaces and line feeds that begin one; at least 1."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"), F.lit(1).cast("long"))


def topic(text: Column, tokens: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit(" | ")), "tabular")
        .when(F.contains(text, F.lit("License")), "licensed")
        .when(tokens >= 2000, "long")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every row."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text", n_tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", "source", "lang", topic(F.col("text"), F.col("tokens")).alias("topic"), "tokens")


def targets(cells: DataFrame, dimension: str, temper: float = TEMPER) -> DataFrame:
    """dimension, target: tempered token shares."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    raised = F.pow(F.col("tokens").cast("double"), F.lit(temper))
    return sums.select(dimension, (raised / F.sum(raised).over(Window.partitionBy(F.lit(dimension)))).alias("target"))  # a row for each name


def _factor(rows: DataFrame, cap: Column, weight: Column, goal: Column, by: list[Column], order: list[Column], name: str) -> DataFrame:
    """rows with `name`: the factor f at which the sum of least(cap, f * weight) within `by` is the goal.

    Rows fill up in the order of cap / weight. With the first k of them full, f would be what
    the goal leaves over the weights of the others; the sum is the least of these lines, so the
    factor is the largest f.
    """
    line = Window.partitionBy(*by).orderBy(cap / weight, *order)
    full = F.coalesce(F.sum(cap).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum(weight).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.withColumn("_line", (goal - full) / free).withColumn(name, F.max("_line").over(Window.partitionBy(*by))).drop("_line")


def attainable(cells: DataFrame, goals: dict[str, DataFrame], budget: float) -> DataFrame:
    """dimension, name, tokens, goal, attainable: goals of at most the tokens there are; what full names lack goes to the others in proportion."""
    lines = []
    for d in DIMENSIONS:
        have = cells.groupBy(F.col(d).alias("name")).agg(F.sum("tokens").cast("double").alias("tokens"))
        lines.append(have.join(goals[d].select(F.col(d).alias("name"), "target"), "name", "left").select(F.lit(d).alias("dimension"), "name", "tokens", F.greatest(F.coalesce("target", F.lit(0.0)), F.lit(1e-250)).alias("target")))
    lines = lines[0].unionByName(lines[1]).unionByName(lines[2])
    whole = Window.partitionBy("dimension")
    asked = F.sum("tokens").over(whole) * min(budget, 1.0)
    lines = lines.withColumn("asked", asked).withColumn("goal", F.col("asked") * F.col("target") / F.sum("target").over(whole))
    lines = _factor(lines, F.col("tokens"), F.col("goal"), F.col("asked"), [F.col("dimension")], [F.col("name")], "factor")
    return materialize(lines.select("dimension", "name", "tokens", "goal", F.least("tokens", F.col("goal") * F.col("factor")).alias("attainable")), "mix-goals")


def rake(cells: DataFrame, lines: DataFrame, budget: float = BUDGET, rounds: int | None = None) -> tuple[DataFrame, float]:
    """Cells with `expected` tokens in the sample, at most their own, that meet the attainable goals, and the largest gap left as a share of the sample.

    lines: of `attainable`. Rounds: until all gaps are within TOLERANCE if not given.
    """
    weighed = cells.withColumn("cap", F.col("tokens").cast("double")).withColumn("weight", F.col("cap") * min(budget, 1.0))
    for d in DIMENSIONS:
        weighed = weighed.join(lines.where(F.col("dimension") == d).select(F.col("name").alias(d), F.col("attainable").alias(f"goal_{d}")), d)
    weighed = materialize(weighed, "mix-weights")
    order, expected = [F.col(d) for d in DIMENSIONS], F.least("cap", "weight")
    done, gap = 0, None
    while True:
        for _ in range(min(STRIDE, (rounds or MOST_ROUNDS) - done)):
            for d in DIMENSIONS:
                weighed = _factor(weighed, F.col("cap"), F.col("weight"), F.col(f"goal_{d}"), [F.col(d)], order, "factor")
                weighed = weighed.withColumn("weight", F.least(F.greatest(F.col("weight") * F.col("factor"), F.lit(1e-250)), F.lit(1e250))).drop("factor")
            done += 1
        weighed = materialize(weighed, "mix-weights")
        gaps = [weighed.groupBy(d).agg(F.abs(F.sum(expected) - F.max(f"goal_{d}")).alias("gap"), F.max(f"goal_{d}").alias("goal")) for d in DIMENSIONS]
        each = [x.agg((F.max("gap") / F.sum("goal")).alias("gap")) for x in gaps]
        gap = each[0].unionByName(each[1]).unionByName(each[2]).agg(F.max("gap")).first()[0] or 0.0
        if done >= (rounds or MOST_ROUNDS) or rounds is None and gap <= TOLERANCE:
            return weighed.select(*DIMENSIONS, "tokens", expected.alias("expected")), gap


def _raked(docs: DataFrame, temper: float, budget: float, goals: dict[str, DataFrame] | None, rounds: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows, cells with their expected tokens, and the attainable goals."""
    rows = materialize(described(docs), "mix-rows")
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    lines = attainable(cells, goals or {d: targets(cells, d, temper) for d in DIMENSIONS}, budget)
    short = [f"{r.dimension} {r.name_!r}" for r in lines.where(F.col("attainable") < F.col("goal") * (1 - TOLERANCE)).select("dimension", F.col("name").alias("name_")).limit(20).collect()]
    if short:
        warnings.warn(f"mixing: fewer tokens than their share, kept whole (up to 20 named): {', '.join(sorted(short))}", stacklevel=3)
    found, gap = rake(cells, lines, budget, rounds)
    if gap > TOLERANCE:
        warnings.warn(f"mixing: the largest gap of a marginal is {gap:.2e} of the sampled tokens", stacklevel=3)
    return rows, found, lines


def calibrated(docs: DataFrame, temper: float = TEMPER, budget: float = BUDGET, goals: dict[str, DataFrame] | None = None, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The described rows, and each cell's probability."""
    rows, found, _ = _raked(docs, temper, budget, goals, rounds)
    cells = materialize(found.select(*DIMENSIONS, (F.col("expected") / F.col("tokens")).alias("probability")), "mix-cells")
    return rows, F.broadcast(cells) if cells.count() <= MOST_BROADCAST else cells


def marginals(docs: DataFrame, temper: float = TEMPER, budget: float = BUDGET, goals: dict[str, DataFrame] | None = None, rounds: int | None = None) -> DataFrame:
    """dimension, name, tokens, goal, attainable goal and expected tokens of the sample."""
    _, found, lines = _raked(docs, temper, budget, goals, rounds)
    sums = [found.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("name")).agg(F.sum("expected").alias("expected")) for d in DIMENSIONS]
    return lines.join(sums[0].unionByName(sums[1]).unionByName(sums[2]), ["dimension", "name"])


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on doc_id alone."""
    digest = F.md5(F.concat(F.lit("mix|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def weigh(docs: DataFrame, **how) -> DataFrame:
    """Every row's doc_id, source, lang, topic, tokens, probability and kept."""
    rows, cells = calibrated(docs, **how)
    out = rows.join(cells, list(DIMENSIONS))
    return out.select("doc_id", *DIMENSIONS, "tokens", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The rows drawn, columns unchanged."""
    _, cells = calibrated(docs, **how)
    named = cells.select(*(F.col(d).alias(f"cell_{d}") for d in DIMENSIONS), F.col("probability").alias("chance"))
    of = topic(docs["text"], n_tokens(docs["text"]))
    same = (F.coalesce(docs["source"], F.lit("")) == named["cell_source"]) & (F.coalesce(docs["lang"], F.lit("")) == named["cell_lang"]) & (of == named["cell_topic"])
    return docs.join(named, same).where(draw(docs["doc_id"]) < named["chance"]).select(*(docs[c] for c in docs.columns))


def sql(rounds: int = SQL_ROUNDS, temper: float = TEMPER, budget: float = BUDGET) -> str:
    """DuckDB form of `weigh`: the rounds are written out one after another."""

    def factor(cap: str, weight: str, goal: str, by: str, order: str, source: str) -> str:
        line = f"(PARTITION BY {by} ORDER BY {cap} / {weight}, {order} ROWS BETWEEN"
        lines = f"SELECT *, ({goal} - coalesce(sum({cap}) OVER {line} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum({weight}) OVER {line} CURRENT ROW AND UNBOUNDED FOLLOWING) AS line FROM {source}"
        return f"(SELECT *, max(line) OVER (PARTITION BY {by}) AS factor FROM ({lines}))"

    parts = [
        """rows_ AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text,
  greatest(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0), 1) AS tokens FROM documents)""",
        """told AS (SELECT doc_id, source, lang, CASE WHEN contains(text, ' | ') THEN 'tabular' WHEN contains(text, 'License') THEN 'licensed'
  WHEN tokens >= 2000 THEN 'long' ELSE 'prose' END AS topic, tokens FROM rows_)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM told GROUP BY ALL)",
        "have AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS name, sum(tokens) AS tokens FROM cells GROUP BY {d}" for d in DIMENSIONS) + ")",
        f"asked AS (SELECT *, {budget} * sum(tokens) OVER w AS asked, {budget} * sum(tokens) OVER w * pow(tokens, {temper}) / sum(pow(tokens, {temper})) OVER w AS goal FROM have WINDOW w AS (PARTITION BY dimension))",
        f"goals AS MATERIALIZED (SELECT dimension, name, least(tokens, goal * factor) AS goal FROM {factor('tokens', 'goal', 'asked', 'dimension', 'name', 'asked')})",
        f"c0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens * {budget} AS weight, "
        + ", ".join(f"(SELECT goal FROM goals WHERE dimension = '{d}' AND name = {d}) AS goal_{d}" for d in DIMENSIONS)
        + " FROM cells)",
    ]
    at = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            found = factor("tokens", "weight", f"goal_{d}", d, ", ".join(DIMENSIONS), f"c{at}")
            parts.append(f"c{at + 1} AS MATERIALIZED (SELECT * EXCLUDE (line, factor) REPLACE (weight * factor AS weight) FROM {found})")
            at += 1
    return (
        "WITH " + ",\n".join(parts) + f""",
p AS (SELECT source, lang, topic, least(tokens, weight) / tokens AS probability FROM c{at})
SELECT t.doc_id, t.source, t.lang, t.topic, CAST(t.tokens AS BIGINT) AS tokens, round(p.probability, 6) AS probability,
  CAST('0x' || substr(md5('mix|' || coalesce(CAST(t.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 < p.probability AS kept
FROM told t JOIN p USING (source, lang, topic)"""
    )
