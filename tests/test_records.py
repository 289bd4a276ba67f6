"""Readers and writers over small files."""

import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import hashing
from evenkeel.jobs import publish
from evenkeel.operators import history, logs
from evenkeel.sources import records
from evenkeel.streaming import logs as streams


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_unfinished_runs_are_left_out(spark, tmp_path):
    for name in ("a", "b", ".c.partial-1"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "measurement.json").write_text(json.dumps({"run_id": name, "run_date": "2026-01-02", "n_valid": {"A": 3}}))
    assert sorted(r.run_id for r in records.measurements(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_the_last_document_of_an_id_holds(spark, tmp_path):
    for name, n in (("1", 30), ("2", 120)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"protocol_id": "p", "n": n}))
    assert [tuple(r) for r in records.protocol_documents(spark, str(tmp_path), "protocol_id string, n int").collect()] == [("p", 120)]


def trial(i):
    return {"record_type": "trial", "run_id": "r", "index": i, "version": "A", "prompt_sha256": f"h{i}", "response_text": "x", "stop_reason": "end_turn"}


def test_a_cut_off_last_line_is_dropped_and_other_damage_refused(spark, tmp_path):
    text = "".join(json.dumps(trial(i)) + "\n" for i in range(3))
    (tmp_path / "ok.jsonl").write_text(text + '{"record_type": "tri')
    saved = records.saved_trials(spark, str(tmp_path / "ok.jsonl"))
    assert [r["index"] for r in saved.orderBy("index").collect()] == [0, 1, 2]
    (tmp_path / "gap.jsonl").write_text("".join(json.dumps(trial(i)) + "\n" for i in (0, 2)))
    with pytest.raises(Exception, match="gap"):
        records.saved_trials(spark, str(tmp_path / "gap.jsonl")).collect()
    (tmp_path / "bad.jsonl").write_text('{"record_type": \n' + text)
    with pytest.raises(Exception, match="unreadable"):
        records.saved_trials(spark, str(tmp_path / "bad.jsonl")).collect()
    schedule = spark.createDataFrame([(i, f"h{i}") for i in range(5)], "index int, prompt_sha256 string")
    assert [r.fetch for r in records.resumed(schedule, saved).orderBy("index").collect()] == [False, False, False, True, True]
    with pytest.raises(Exception, match="another prompt"):
        records.resumed(schedule.withColumn("prompt_sha256", F.lit("no")), saved).collect()


def test_many_cut_off_runs_are_read_at_once(spark, tmp_path):
    """The last line is known by its place, for each file by itself, even where an inner line has the same text."""
    half = '{"record_type": "tri'
    for k in range(300):
        (tmp_path / f"run-{k}.jsonl").write_text("\n".join(json.dumps(trial(i)) for i in range(k % 4)) + ("\n" + half if k % 2 else "\n\n \n"))
    found = records.saved_trials(spark, f"{tmp_path}/run-*.jsonl").groupBy("file").count().collect()
    assert sorted(r["count"] for r in found) == sorted(k % 4 for k in range(300) if k % 4)
    assert records.saved_trials(spark, [f"{tmp_path}/run-3.jsonl", f"{tmp_path}/run-2.jsonl"]).count() == 5
    (tmp_path / "twice.jsonl").write_text(json.dumps(trial(0)) + "\n" + half + "\n" + half)
    with pytest.raises(Exception, match="unreadable line that isn't the last at line 2"):
        records.saved_trials(spark, f"{tmp_path}/twice.jsonl").collect()
    (tmp_path / "other.jsonl").write_text(json.dumps(trial(0) | {"record_type": "run"}) + "\n")
    with pytest.raises(Exception, match="no trial"):
        records.saved_trials(spark, f"{tmp_path}/other.jsonl").collect()


def test_runs_are_known_by_folder_names(spark, tmp_path):
    for name in ("2026-01-05__fam__order__v0__m-1__r2", "junk__x", "2026-13-01__a__b__m__r1"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text("x")
    assert [tuple(r) for r in records.runs_by_name(spark, str(tmp_path)).collect()] == [(date(2026, 1, 5), "fam__order__v0", "m-1", 2)]


def test_cadence_takes_bare_intervals_alone(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# top\nsweep: 30d  # monthly\nalert: 36h\nlimit: 4\nwhen: on_change\n")
    assert {tuple(r) for r in records.cadence(spark, str(tmp_path / "c.txt")).collect()} == {("sweep", 30.0), ("alert", 1.5)}


def test_the_last_active_generation_counts(spark):
    text = "series:\n  commercial:\n    - model_id: a\n      status: active\n    - model_id: b  # newer\n      status: active\n    - model_id: c\n      status: pending\n  open_weights:\n    - model_id: o\n      status: active\n"
    df = spark.createDataFrame(records.generations(text), records.GENERATION)
    assert {tuple(r) for r in records.active_models(df).collect()} == {("commercial", "b"), ("open_weights", "o")}


def test_generations_of_any_series():
    text = """version: 1
series:
  # two tracks
  paid:
    tier: large
    generations:
      - model_id: a-1   # first
        model_family: "a"
        status: retired
        declared_successor: a-2
      - model_id: 'a-2'
        status: active
        declared_successor: null
  free:
    generations:
      - model_id: null
        status: pending
      - model_id: o
        model_family: o-line
other:
  - model_id: no
"""
    assert records.generations(text) == [(0, "paid", "a-1", "a", "retired", "a-2"), (1, "paid", "a-2", None, "active", None), (2, "free", "o", "o-line", None, None)]
    assert records.generations("") == []


def test_manifests_need_a_proof_of_their_content(spark, tmp_path):
    entry = [{"protocol_id": "p", "panel_sha256": "x", "protocol_sha256": "y"}]
    for name, honest in (("a.json", True), ("b.json", False)):
        content = json.dumps(entry if honest else [{**entry[0], "protocol_id": "q"}]).encode()
        (tmp_path / name).write_bytes(content)
        digest = hashlib.sha256(content if honest else b"other").digest()
        (tmp_path / f"{name}.ots").write_bytes(b"h" * 33 + digest + (b"\x05\x88" if honest else b""))
    found = records.stamped_manifests(spark, str(tmp_path), "protocol_id string, panel_sha256 string, protocol_sha256 string").collect()
    assert [r.protocol_id for r in found] == ["p"]
    assert [r.path.rsplit("/", 1)[1] for r in records.pending_proofs(spark, str(tmp_path), "0588").collect()] == ["b.json.ots"]


def test_a_missing_log_is_empty(spark, tmp_path):
    assert records.observations(spark, str(tmp_path / "none")).count() == 0


def test_published_files(spark, tmp_path):
    rows = spark.createDataFrame([("r2", None, ["x", 'q"']), ("r1", True, [])], "run_id string, on_curve boolean, flags array<string>")
    publish.write_csv(rows, str(tmp_path / "csv"), ["run_id"])
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).orderBy("run_id").collect()
    assert [(r.run_id, r.on_curve, r.flags) for r in back] == [("r1", "True", "[]"), ("r2", None, '["x", "q\\""]')] or back[1].flags.startswith('["x", ')
    with pytest.raises(Exception):
        publish.write_csv(rows, str(tmp_path / "csv"), ["run_id"])
    described = json.loads(publish.descriptor("d", {"t": rows}))
    assert [f["dataType"] for f in described["recordSet"][0]["field"]] == ["sc:Text", "sc:Boolean", "sc:Text"]
    assert publish.file_manifest(spark, str(tmp_path / "csv")).where("size like '% B'").count() >= 1


def test_only_open_trials_are_published(spark, tmp_path):
    trials = spark.createDataFrame([("o", 1, "t"), ("s", 1, "t"), ("o", 0, "t")], "run_id string, place int, text string")
    m = spark.createDataFrame([("o", "open", date(2026, 1, 1)), ("s", "sealed", date(2026, 1, 1))], "run_id string, lane string, run_date date")
    publish.write_open_trials(trials, m, str(tmp_path / "open"))
    found = spark.read.json(str(tmp_path / "open")).collect()
    assert {(r.run_id, r.place, r.year) for r in found} == {("o", 0, 2026), ("o", 1, 2026)}


def test_log_lines_are_checked(spark, tmp_path):
    ok = spark.createDataFrame([("j", date(2026, 1, 1), True, None)], "job string, day date, ran boolean, cause string")
    publish.append_observations(ok, str(tmp_path / "log"), ["x"])
    bad = spark.createDataFrame([("j", date(2026, 1, 1), False, "y")], ok.schema)
    with pytest.raises(Exception, match="unknown cause"):
        publish.append_observations(bad, str(tmp_path / "log"), ["x"])
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_a_blocked_protocol_stops_the_bundle(spark, tmp_path):
    protocols = spark.createDataFrame([("p",), ("q",)], "protocol_id string")
    trials = spark.createDataFrame([("p", "r", 1)], "protocol_id string, run_id string, place int")
    reasons = lambda *b: spark.createDataFrame([("p", []), ("q", list(b))], "protocol_id string, broken array<string>")
    with pytest.raises(ValueError):
        publish.write_declassified(protocols, trials, reasons("still_current"), str(tmp_path / "b"))
    publish.write_declassified(protocols, trials, reasons(), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b/trials")).count() == 1


def test_near_pairs_meet_once(spark):
    days = [date(2026, 1, d) for d in (1, 8, 9, 16, 31)]
    a = spark.createDataFrame([(1, d) for d in days], "k int, x date")
    b = spark.createDataFrame([(1, d) for d in days], "k int, y date")
    found = sorted((r.x, r.y) for r in history.near(a, b, ["k"], "x", "y", 7).collect())
    assert found == sorted((x, y) for x in days for y in days if abs((x - y).days) <= 7)


def test_sweep_admission_follows_the_ladder(spark):
    rows = [(f"p{i:02}", i, "guard" if i % 2 else "open", i == 0, i != 1, 10, 50, 100) for i in range(9)]
    df = spark.createDataFrame([("s", *r) for r in rows], "sweep string, protocol_id string, place int, lane string, already_run boolean, preregistered boolean, cost bigint, spent bigint, ceiling bigint")
    found = {r.place: (r.skipped, r.rung) for r in logs.admit(df, ["sweep"], ["protocol_id", "place"]).collect()}
    assert found[0][0] == "already_run_this_month" and found[1][0] == "not_preregistered"
    assert found[2] == (None, "full") and found[3] == (None, "reduced_sweep") and found[4] == (None, "reduced_sweep")
    assert found[5] == (None, "guard_only_sweep") and found[6] == ("budget_halted", "guard_only_sweep") and found[8][0] == "budget_halted"


def test_a_sweep_ends_where_funds_or_the_circuit_do(spark):
    rows = [("a", 0, None, None), ("a", 1, "ran_today", None), ("a", 2, None, 45), ("a", 3, "no_funds", None), ("a", 4, None, None), ("b", 0, "circuit_open", None), ("b", 1, None, None), ("c", 0, None, 70), ("c", 1, None, None)]
    df = spark.createDataFrame([(s, f"p{k}", "open", False, True, 10, 0, 100, met, actual) for s, k, met, actual in rows], "sweep string, protocol_id string, lane string, already_run boolean, preregistered boolean, cost bigint, spent bigint, ceiling bigint, met string, actual bigint")
    found = {(r.sweep, r.protocol_id): (r.skipped, r.rung, r.funds_exhausted) for r in logs.admit(df, ["sweep"], ["protocol_id"]).collect()}
    assert found == {
        ("a", "p0"): (None, "full", False), ("a", "p1"): ("already_ran_today", "full", False), ("a", "p2"): (None, "full", False), ("a", "p3"): ("budget_halted", "full", True), ("a", "p4"): ("not_reached", None, False),
        ("b", "p0"): ("circuit_open", "full", False), ("b", "p1"): ("not_reached", None, False), ("c", "p0"): (None, "full", False), ("c", "p1"): (None, "reduced_sweep", False),
    }
    assert logs.admit(df.limit(0), ["sweep"], ["protocol_id"]).count() == 0


def test_a_sweep_of_many_protocols_is_one_stream(spark):
    """State carried over batches, figures that are not known, and no sweep gathered in one row."""
    rows = [("s", k, "guard" if k % 3 else None, None if k % 10 == 0 else False, None if k % 10 == 1 else True, 1, None if k > 90 else 0, 100, None, None if k % 2 else 2) for k in range(100)]
    rows += [("t", k, "open", False, True, 0, 0, 10**9, "ran_today" if k % 2 else None, None) for k in range(20_000)]
    df = spark.createDataFrame(rows, "sweep string, k int, lane string, already_run boolean, preregistered boolean, cost bigint, spent bigint, ceiling bigint, met string, actual bigint")
    out = logs.admit(df.repartition(5), ["sweep"], ["k"])
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {(r.sweep, r.k): (r.skipped, r.rung, r.funds_exhausted) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows) and all(found["t", k] == ("already_ran_today" if k % 2 else None, "full", False) for k in range(20_000))
    assert [found["s", k][:2] for k in (0, 1, 39, 40, 41, 92)] == [(None, "full"), (None, "full"), (None, "full"), ("budget_halted", "reduced_sweep"), ("budget_halted", "reduced_sweep"), (None, None)]


def test_streamed_checks_equal_batch(spark, tmp_path):
    rows = [{"job": f"j{i}", "date": f"2026-01-0{1 + i % 3}", "ran": i % 4 != 0, "cause": None} for i in range(30)]
    lines(tmp_path / "in" / "a.json", rows[:15])
    lines(tmp_path / "in" / "b.json", rows[15:])
    stream = streams.daily_checks(streams.observation_stream(spark, str(tmp_path / "in"), 1))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    want = logs.daily(spark.read.schema(records.OBSERVATION).json(str(tmp_path / "in")).withColumnRenamed("date", "day"))
    assert {tuple(r) for r in spark.table("daily").collect()} == {tuple(r) for r in want.collect()}
    writer = streams.append_each(streams.observation_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck2"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_files_hash_is_that_of_paths_and_contents_in_order(spark):
    files = [("b/2.txt", "two é"), ("a.txt", ""), ("b/10.txt", "ten")]
    want = hashlib.sha256()
    for path, content in sorted(files):
        want.update(path.encode() + b"\0" + content.encode() + b"\0")
    df = spark.createDataFrame([(files,)], "files array<struct<path:string,content:string>>")
    assert df.select(hashing.files_sha256(F.col("files"))).first()[0] == want.hexdigest()


def test_a_run_stops_at_once_or_after_five_failures(spark):
    calls = [("a", i, True, 500) for i in range(4)] + [("a", 4, False, None)] + [("a", 5 + i, True, 500) for i in range(5)]
    calls += [("b", 0, False, None), ("b", 1, True, 404), ("c", 0, True, 500), ("d", 0, True, 429)]
    df = spark.createDataFrame([(*c, "credit balance is too low" if c[0] == "d" else "x") for c in calls], "run string, at long, failed boolean, status int, message string")
    assert {tuple(r) for r in logs.run_stops(df, ["run"], "at").collect()} == {("a", 9, "failures"), ("b", 1, "status"), ("d", 0, "funds")}


def test_lists_alarms_and_names(spark, tmp_path):
    (tmp_path / "list.json").write_text('{"declassified": [{"protocol_id": "p1", "date": "2026-01-01", "reason": "old"}]}')
    assert [tuple(r) for r in records.declassified(spark, str(tmp_path / "list.json")).collect()] == [("p1", "2026-01-01", "old")]
    (tmp_path / "bad.json").write_text('{"declassified": [{"protocol_id": "p1", "date": "", "reason": "old"}]}')
    with pytest.raises(Exception, match="needs protocol_id"):
        records.declassified(spark, str(tmp_path / "bad.json")).collect()
    models = spark.createDataFrame([(0, "commercial", "m1", "retired"), (1, "commercial", "m2", "active")], "place int, series string, model_id string, status string")
    assert records.model_in_use(models, "commercial") == "m2" and records.model_in_use(models, "commercial", "m9") == "m9"
    with pytest.raises(LookupError):
        records.model_in_use(models, "open_weights")
    alarm = spark.createDataFrame([("2026-01-01", False, None, True, False, "g1", 5)], "run_date string, ok boolean, flag string, runtime_fingerprint_ok boolean, guard_margin_ok boolean, guard_protocol_id string, more int")
    for _ in range(2):
        publish.append_alarms(alarm, str(tmp_path / "alarms"))
    assert spark.read.text(str(tmp_path / "alarms")).collect()[1][0] == '{"run_date":"2026-01-01","ok":false,"flag":null,"runtime_fingerprint_ok":true,"guard_margin_ok":false,"guard_protocol_id":"g1"}'
    publish.write_once(alarm, str(tmp_path / "once"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        publish.write_once(alarm, str(tmp_path / "once"))
    assert publish.misnamed_percentages({"a_pct": "percent", "b": "percent", "c_pct": "count", "n": "count"}, {"percent"}) == ["b", "c_pct"]


def test_bridge_steps_and_spend_entries(spark):
    done = spark.createDataFrame([("m1", "p1", "2026-01"), ("m2", "p1", "2026-01"), ("m2", "p2", "2026-02"), ("m3", "p1", "2026-02")], "new_model string, protocol_id string, month string")
    listed = spark.createDataFrame([("m1",), ("m2",)], "new_model string")
    bills = spark.createDataFrame([(date(2026, 1, 5), "bridge", 3), (date(2026, 2, 5), "bridge", 0), (date(2026, 2, 5), "sweep", 9)], "run_date date, category string, amount int")
    sweeps = spark.createDataFrame([("2026-02",)], "month string")
    rows = sorted(tuple(r) for r in logs.bridge_steps(done, listed, bills, sweeps).collect())
    assert rows == [("m2", "p2", "2026-02", True, False, True, 1), ("m3", "p1", "2026-02", False, False, True, 2)]
    runs = spark.createDataFrame([("r1", "sweep", 1000, 10, 3, 15), ("r2", "sweep", 0, 0, 3, 15), ("r3", "sweep", 10, 10, None, None)], "run_id string, category string, tokens_in long, tokens_out long, price_in int, price_out int")
    found = [tuple(r) for r in logs.spend_entries(runs).collect()]
    assert found == [("r1", "sweep", 0.0032, "sweep; tokens x list price (1000 in / 10 out), not yet reconciled")]


def test_runs_state_and_sessions(spark, tmp_path):
    trials = spark.createDataFrame([("r1", 0, "A")], "run_id string, index int, token string")
    figures = spark.createDataFrame([("r1", 90.0)], "run_id string, stability_pct double")
    publish.write_run(trials, figures, str(tmp_path / "r1"))
    assert spark.read.json(str(tmp_path / "r1" / "measurement")).collect()[0]["stability_pct"] == 90.0
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        publish.write_run(trials, figures, str(tmp_path / "r1"))
    state = lambda *rows: spark.createDataFrame(rows, "job string, last_run string")
    publish.upsert_state(state(("a", "2026-01-03"), ("b", "2026-01-01")), state(("a", "2026-01-02"), ("b", "2026-01-05"), ("c", "2026-01-01")), str(tmp_path / "state"))
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "state")).select("job", "last_run").collect()) == [("a", "2026-01-03"), ("b", "2026-01-05"), ("c", "2026-01-01")]
    seen = spark.sql("SELECT job, timestamp(at) AS at FROM VALUES ('a', '2026-01-01 00:00:00'), ('a', '2026-01-02 06:00:00'), ('a', '2026-01-05 00:00:00'), ('b', '2026-01-01 00:00:00') AS t(job, at)")
    found = streams.activity_gaps(seen, "job", "at").selectExpr("job", "string(first)", "events").collect()
    assert sorted(tuple(r) for r in found) == [("a", "2026-01-01 00:00:00", 2), ("a", "2026-01-05 00:00:00", 1), ("b", "2026-01-01 00:00:00", 1)]
