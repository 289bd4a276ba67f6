"""Streams with state against their batch forms, over batches cut anywhere and after a restart."""

import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evenkeel.operators import logs
from evenkeel.streaming import logs as streams

CALL = "run string, place int, failed boolean, status int, message string"


def made_calls():
    rng = random.Random(5)
    rows = []
    for run in range(12):
        for place in range(40):
            failed = rng.random() < (0.75 if run % 3 else 0.2)
            status = rng.choice([None, 500, 500, 500, 401 if run % 4 == 1 else 500, 402 if run % 4 == 2 else 500]) if failed else None
            rows.append({"run": f"r{run}", "place": place, "failed": failed, "status": status, "message": "your credit balance is too low" if status == 402 else "x"})
    return rows


def cut(folder, rows, cuts):
    """Files of rows, each its own batch, in order."""
    folder.mkdir(exist_ok=True)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        file = folder / f"{a:06}.json"
        if a < b and not file.exists():
            file.write_text("".join(json.dumps(r, default=str) + "\n" for r in rows[a:b]))
            os.utime(file, (1_700_000_000 + a, 1_700_000_000 + a))  # files are taken in order of time


def run_stream(df, out, checkpoint):
    streams.append_each(df, out, checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_breakers_over_batches_and_a_restart(spark, tmp_path):
    rows = sorted(made_calls(), key=lambda r: (r["place"], r["run"]))
    want = {tuple(r) for r in logs.run_stops(spark.createDataFrame([tuple(r.values()) for r in rows], CALL), ["run"], "place").collect()}
    assert {w for *_, w in want} == {"funds", "status", "failures"} and len(want) < 12
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    follow = lambda: streams.run_stops(spark.readStream.schema(CALL).option("maxFilesPerTrigger", 1).json(str(source)), "run", "place")
    cuts = [3, 50, 51, 200]
    cut(source, rows[:200], cuts[:3])
    run_stream(follow(), out, state)
    cut(source, rows, cuts)  # more files come while nothing runs
    run_stream(follow(), out, state)
    found = [tuple(r) for r in spark.read.parquet(out).select("run", "stopped_at", "why").collect()]
    assert set(found) == want and len(found) == len(want)


def test_silence_is_told_once_by_a_timer(spark, tmp_path):
    begin = datetime(2026, 1, 1)
    hours = {"a": [0, 10, 20, 90, 95], "b": [0, 36, 73], "c": [5], "clock": list(range(0, 150, 6))}
    rows = sorted(({"bot": k, "ts": begin + timedelta(hours=h)} for k, times in hours.items() for h in times), key=lambda r: (r["ts"], r["bot"]))
    kind = "bot string, ts timestamp"
    batch = logs.silences(spark.createDataFrame([tuple(r.values()) for r in rows], kind), "bot", "ts", 36)
    want = {(r.bot, r["last"]) for r in batch.collect()}
    at = lambda k, h: (k, begin + timedelta(hours=h))
    assert want == {at("a", 20), at("a", 95), at("b", 36), at("b", 73), at("c", 5)}
    source = tmp_path / "in"
    cut(source, rows, [2, 9, 17, 30])
    follow = streams.silences(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(source)), "bot", "ts", 36)
    run_stream(follow, str(tmp_path / "out"), str(tmp_path / "state"))
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("bot", "last").collect()]
    assert set(found) == want and len(found) == len(want)
    assert batch.where(F.col("silent_at") != F.col("last") + F.expr("interval 36 hours")).count() == 0


def test_runs_of_failures_go_on_over_pieces(spark):
    rng = random.Random(9)
    rows = [(c, k, rng.random() < share) for c, n, share in (("hot", 3000, 0.8), ("all", 500, 1.1), ("few", 7, 0.9), (None, 60, 0.7), ("none", 40, 0.0)) for k in range(n)]
    want, streak = set(), []
    for client in ("hot", "all", "few", None, "none"):
        for c, k, failed in [r for r in rows if r[0] == client] + [(client, None, False)]:
            if failed:
                streak.append(k)
                continue
            if len(streak) >= 5:
                want.add((client, streak[0], streak[-1], len(streak)))
            streak = []
    rng.shuffle(rows)
    calls = spark.createDataFrame(rows, "client string, place int, failed boolean")
    for pieces in ("1", "4", "37"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", pieces)
        try:
            found = [tuple(r) for r in logs.error_runs(calls, ["client"], "place").select("client", "first", "last", "length").collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert set(found) == want and len(found) == len(want)
    assert logs.error_runs(calls.limit(0), ["client"], "place").count() == 0
