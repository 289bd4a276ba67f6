"""The decision grammar, native and exact paths alike."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.functions import grammar as G
from evenkeel.operators import rewording

CASES = [
    ("thinking it over\nDECISION: B", "valid", "B", None),
    ("I would take B in the end.", "unparseable", None, "no_decision_line"),
    ("Decision: A\nonce more\n**decision: a.**", "valid", "A", None),
    ("DECISION: A\nDECISION: B", "unparseable", None, "conflicting_decisions"),
    ("DECISION: maybe", "unparseable", None, "token_not_in_options"),
    ("DECISION: hard to say\nDECISION: A", "unparseable", None, "token_not_in_options"),
    ("", "empty", None, "empty_response"),
    (" \n\t ", "empty", None, "empty_response"),
    (None, "empty", None, "empty_response"),
    ("decision : a", "valid", "A", None),
    ("decision:\tB !", "valid", "B", None),
    ("my decision: A", "unparseable", None, "no_decision_line"),
    ("decision：b", "valid", "B", None),
    ("dé́ x\nDecision: `A`;", "valid", "A", None),
    ("DECISION: A\x1cDECISION: A", "valid", "A", None),
    ("DECISION:", "unparseable", None, "token_not_in_options"),
]


@pytest.mark.parametrize("version", [1, 2])
def test_cases(spark, version):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "i int, text string")
    found = {r.i: tuple(r.read) for r in G.extract(df, ["A", "B"], version).collect()}
    for i, (text, *want) in enumerate(CASES):
        if version == 2 and want[2] == "token_not_in_options":
            want = ["valid", "A", None] if "DECISION: A" in text else ["unparseable", None, "no_decision_line"]
        assert found[i] == tuple(want), text


def test_native_and_exact_paths_agree(spark):
    lines = st.sampled_from(["decision: a", "Decision:B.", "DECISION:  `a` ", "**Decision: b**", "decision: c", "hm", "", "decision :a;", "_decision: B_ !", "a decision: a", "\tdecision: a"])
    texts: list[str] = []

    @settings(max_examples=150, deadline=None)
    @given(st.lists(lines, max_size=4), st.sampled_from(["\n", "\r\n", "\r", "\x0b", "\x1d"]))
    def gather(parts, joint):
        texts.append(joint.join(parts))

    gather()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for version in (1, 2):
        native = [tuple(r.read) for r in df.select("i", G.native_extract(df.text, ["A", "B"], version).alias("read")).orderBy("i").collect()]
        exact = [tuple(None if v is None or v != v else v for v in row) for row in G.exact_extract(pd.Series(texts), ["A", "B"], version).itertuples(index=False)]
        assert native == exact


def test_alike_options_are_an_error():
    with pytest.raises(ValueError):
        G.option_table(["A", "a."])


def test_classification_goes_by_precedence(spark):
    rows = [("DECISION: A", "timeout", "refusal"), ("DECISION: A", None, "refusal"), ("DECISION: A", None, "max_tokens"), (None, None, "end_turn"), ("DECISION: A", None, "end_turn")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, error string, stop_reason string")
    found = [r.outcome for r in G.classify(df, ["A", "B"], 2).orderBy("i").collect()]
    assert found == ["blocked_upstream", "refused", "truncated", "off_format", "valid"]


def test_folding_is_that_of_unicode(spark):
    ranges = [(1, 0x1C89), (0x1E00, 0x2C00), (0xAB70, 0xABC0), (0xFB00, 0xFB20), (0x10400, 0x10500)]  # older than either Unicode version in use
    letters = [chr(c) for low, high in ranges for c in range(low, high)] + ["Straße ΟΔΟΣ İIıi", "ΣΑΣ ΣΑΣ"]
    found = spark.createDataFrame([(x,) for x in letters], "t string").select("t", G.folded(F.col("t")).alias("f")).collect()
    assert [r.t for r in found if r.f != r.t.casefold()] == []
    bare = spark.createDataFrame([("Straße, 1_a",)], "t string").select(G.surface_skeleton(F.col("t"))).first()[0]
    assert bare == "strasse1a"


@pytest.mark.parametrize("status, message, funds", [(400, "Your credit balance is too low", True), (429, "You have reached your specified API usage limits", True), (429, "rate limit exceeded", False), (400, "Invalid billing address field", False), (500, "credit balance is too low", False), (None, "api usage limits", False), (403, None, False)])
def test_funds_errors(spark, status, message, funds):
    df = spark.createDataFrame([(status, message)], "s int, m string")
    assert df.select(G.funds_error(F.col("s"), F.col("m"))).first()[0] is funds


PAIRS = [
    ("wording", "risky_choice_framing", "x\nPlan A: save 1", "x\nPlan A: lose 2", []),
    ("wording", "risky_choice_framing", "x\nPlan A: save 1", "y\nPlan A: save 1", ["other_line_changed"]),
    ("wording", "risky_choice_framing", "x", "x", ["unchanged"]),
    ("wording", "sunk_cost_fallacy", "So far, €1,000 has been spent\nOption A: stop now", "So far, €1,000 has been spent\nOption A: stop, giving up the €1,000 already spent, now", []),
    ("wording", "sunk_cost_fallacy", "So far, €1,000 has been spent\nOption A: stop now", "So far, €1,000 has been spent\nOption A: stop, giving up the €2,000 already spent, now", ["not_the_phrase"]),
    ("wording", "base_rate_neglect", "o\n1% of the people are ill and it wrongly flags 10% more", "o\nOut of every 1,000 people, 10 are ill and it wrongly flags 99 more", []),
    ("wording", "base_rate_neglect", "o\n1% of the people are ill and it wrongly flags 10% more", "o\nOut of every 1,000 people, 10 are ill and it wrongly flags 100 more", ["rates_differ"]),
    ("order", "f", "x\nPlan A: 1\nPlan B: 2", "x\nPlan B: 2\nPlan A: 1", []),
    ("order", "f", "x\ny\nPlan A: 1\nPlan B: 2", "y\nx\nPlan B: 2\nPlan A: 1", ["other_lines_changed"]),
    ("default", "f", "Plan A is taken by default", "Plan B is taken by default", []),
    ("default", "f", "Plan A is taken by default", "Plan B was taken by default", ["more_than_the_letter"]),
    ("anchoring", "f", "said 500, cost 31 €", "said 900, cost 31 €", []),
    ("anchoring", "f", "said 500, cost (31) €", "said 31, cost (31) €", ["anchor_repeated"]),
    ("anchoring", "f", "said 500", "said 5 00", ["not_one_token"]),
    ("other", "f", "a", "b", ["no_rule"]),
    ("order", "f", None, "b", ["no_text"]),
]


def test_rewording_rules(spark):
    df = spark.createDataFrame([(i, *p[:4]) for i, p in enumerate(PAIRS)], "i int, kind string, family string, a string, b string")
    found = df.select("i", rewording.broken_rules(*(F.col(c) for c in ("kind", "family", "a", "b"))).alias("broken")).collect()
    assert [r.broken for r in sorted(found)] == [p[4] for p in PAIRS]
