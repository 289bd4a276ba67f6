"""Canonical JSON against the standard writer, for nested and odd values."""

import hashlib
import json
import random
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import canonical, hashing
from evenkeel.functions.exact import rounded

NUMBERS = [0.0, -0.0, 1.0, -0.0004, 0.0001, 1e-05, 1.5e-07, 1e15, 1e16, 1.5e16, 123456789012345680.0, 2e23, 5e-324, 1.7976931348623157e308, 7.03382088603836e18, 0.1, 1 / 3, float("inf"), float("-inf")]
TEXTS = ["", "plain", 'a "quote" \\ back', "é", "\U0001f600 astral", "\x00\x1f\x7f\b\f\n\r\t", "/<>&' ", "‖"]


def test_numbers_in_the_fewest_digits(spark):
    rng = random.Random(3)
    values = NUMBERS + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(20_000)] + [rng.random() * 10 ** rng.randint(-20, 25) for _ in range(20_000)] + [round(-20 * rng.random(), 4) for _ in range(5_000)]
    values = [v for v in values if v == v]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", canonical.number(F.col("x")).alias("t")).collect()
    wrong = [(r.x, r.t) for r in rows if r.t != json.dumps(r.x)]
    # the platform's own digits may be a neighbour of the nearest form of equal length; reading back is always exact
    assert all(float(t) == x for x, t in wrong) and len(wrong) < len(values) / 2_000, wrong[:9]
    assert not {x for x, _ in wrong} & set(NUMBERS), wrong[:5]


def test_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", canonical.quoted(F.col("t")).alias("a"), canonical.quoted(F.col("t"), ascii=True).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(json.dumps(t, ensure_ascii=False), json.dumps(t)) for t in TEXTS]


KIND = "z long, a struct<c: string, b: array<double>, m: map<string, struct<y: boolean, x: map<string, long>>>>, d date, n decimal(20,0), nothing string, k array<array<string>>"
NESTED = {"z": 7, "a": {"c": "é", "b": [1e-05, None, 2.0], "m": {"ß": {"y": True, "x": {"2": 1, "10": 2, "A": None}}, "b": None, "a\"": {"y": None, "x": {}}}}, "d": None, "n": 12345678901234567890, "nothing": None, "k": [["x"], [], None]}


def test_nested_values(spark):
    from decimal import Decimal

    kind = T.StructType.fromDDL(KIND)
    row = spark.createDataFrame([(NESTED | {"n": Decimal(NESTED["n"])},)], T.StructType([T.StructField("v", kind)]))
    for ascii in (False, True):
        got = row.select(canonical.json_text(F.col("v"), kind, ascii).alias("t")).first().t
        assert got == json.dumps(NESTED, sort_keys=True, ensure_ascii=ascii, separators=(",", ":"))
    flat = row.select("v.*")
    assert flat.select(canonical.row_json(flat.schema, "z", "a", "nothing").alias("t")).first().t == json.dumps({k: NESTED[k] for k in ("z", "a", "nothing")}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_fingerprints_of_replies(spark):
    rng = random.Random(8)
    value = lambda: rng.choice([-0.0, -0.0004, -0.00004, -1e-9, -0.00005, -0.12355, -rng.random(), -30 * rng.random()])
    text = lambda: "".join(rng.choice(["a", "é", "\U0001f600", '"', "\n", " ", "\x7f"]) for _ in range(rng.randint(0, 6)))
    replies = [(text(), [{text(): value() for _ in range(rng.randint(0, 4))} for _ in range(rng.randint(0, 3))]) for _ in range(300)]
    want = [hashlib.sha256(json.dumps({"text": t, "tokens": [{k: round(v, 4) for k, v in s.items()} for s in steps]}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for t, steps in replies]
    rows = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(replies)], "k int, t string, s array<map<string, double>>")
    assert [r.h for r in rows.orderBy("k").select("k", hashing.logprob_fingerprint(F.col("t"), F.col("s")).alias("h")).collect()] == want


def test_rounding_goes_by_the_exact_value(spark):
    rng = random.Random(5)
    values = [0.12355, 0.12345, 2.5, -0.00005, -0.0, -0.00001, 0.5, 1.00005, -1.00015, 0.0, 1e-9] + [rng.randint(-10**7, 10**7) / 10**5 for _ in range(5_000)] + [rng.uniform(-30, 0) for _ in range(2_000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", rounded(F.col("x"), 4).alias("r"), rounded(F.col("x"), 0).alias("w")).collect()
    assert [(repr(r.r), repr(r.w)) for r in rows] == [(repr(round(r.x, 4)), repr(round(r.x, 0))) for r in rows]
