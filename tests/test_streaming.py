import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gavelspark.functions.decisions import Thresholds
from gavelspark.sources.readers import stream_table
from gavelspark.streaming import moderation as mo
from gavelspark.streaming import monitoring as mn
from gavelspark.streaming.runner import latest_available, write_available

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def folder_of(tmp_path, name, frames):
    """A table folder with one file per frame, in the given order."""
    import time

    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}.parquet"))
        time.sleep(0.05)
    return str(tmp_path)


@pytest.fixture
def log(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, at(i * 0.5), rng.choice([200, 200, 503]), rng.uniform(0, 400), rng.choice(["ALLOW", "REJECT", "ESCALATE"])) for i in range(600)]
    schema = "event_id long, ts timestamp, status int, latency_ms double, decision string"
    frames = [spark.createDataFrame(rows[i : i + 200], schema) for i in range(0, 600, 200)]
    return rows, folder_of(tmp_path, "log", frames)


def test_running_counts(spark, log):
    rows, folder = log
    counts = latest_available(mo.running_counts(stream_table(spark, folder, "log", max_files=1)), "running", ["decision"])
    got = {r.decision: (r.requests, r.mean_latency_ms) for r in counts.collect()}
    for decision in ("ALLOW", "REJECT", "ESCALATE"):
        latencies = [r[3] for r in rows if r[4] == decision]
        assert got[decision] == (len(latencies), pytest.approx(sum(latencies) / len(latencies)))


def test_closed_windows_over_several_batches(spark, log):
    rows, folder = log
    stream = mo.windowed_counts(stream_table(spark, folder, "log", max_files=1), width="30 minutes", late="10 minutes")
    got = {(r.window_start, r.decision): r.n for r in write_available(stream, "w").collect()}
    newest = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    expected = {}
    for _, ts, _, _, decision in rows:
        start = ts.replace(minute=ts.minute // 30 * 30, second=0, microsecond=0)
        if start + dt.timedelta(minutes=30) <= newest:
            expected[start, decision] = expected.get((start, decision), 0) + 1
    assert got == expected and got


def test_open_windows_come_out_too(spark, log):
    rows, folder = log
    stream = mo.windowed_counts(stream_table(spark, folder, "log", max_files=1), width="30 minutes", late="10 minutes")
    found = latest_available(stream, "w", ["window_start", "decision"])
    assert sum(r.n for r in found.collect()) == len(rows)
    assert found.select("window_start", "decision").distinct().count() == found.count()


def test_alarm_after_an_outage(spark, tmp_path):
    """Minutes of errors, then hours of healthy traffic: the alarms are those of the table."""
    outage = [(at(m) + dt.timedelta(seconds=s), 503) for m in range(5) for s in range(6)]
    healthy = [(at(10 + 5 * m), 200) for m in range(70)]
    schema = "ts timestamp, status int"
    frames = [spark.createDataFrame(part, schema) for part in (outage, healthy[:30], healthy[30:])]
    folder = folder_of(tmp_path, "log", frames)
    for write in (lambda s: write_available(s, "m"), lambda s: latest_available(s, "m", ["minute"])):
        minutes = write(mn.error_minutes(stream_table(spark, folder, "log", max_files=1)))
        assert sorted(r.alarm_at for r in mn.error_alarms(minutes).collect()) == [at(m) for m in range(1, 5)]


def test_stream_continues_from_its_checkpoint(spark, tmp_path):
    schema = "event_id long, ts timestamp, decision string"
    first = spark.createDataFrame([(1, at(0), "ALLOW")], schema)
    folder = folder_of(tmp_path / "in", "log", [first, first.withColumn("event_id", F.lit(2).cast("long"))])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        return write_available(stream_table(spark, folder, "log"), "log", folder=out, checkpoint=checkpoint)

    assert run().count() == 2
    assert run().count() == 2
    folder_of(tmp_path / "in", "log", [first.withColumn("event_id", F.lit(3).cast("long"))])
    assert sorted(r.event_id for r in run().collect()) == [1, 2, 3]


def test_moderation_drops_text_and_refuses_bad_requests(spark):
    frame = spark.createDataFrame(
        [("hello", "ref", 0.9, 0.05, 0.05), ("", "ref", 0.9, 0.05, 0.05), ("x" * 20_001, "ref", 0.9, 0.05, 0.05),
         ("maybe", "r" * 501, 0.9, 0.05, 0.05), ("unsure", "ref", 0.4, 0.3, 0.3)],
        "text string, content_reference string, p_allow double, p_escalate double, p_reject double",
    )
    decided = mo.moderate(frame, model_id="m", thresholds=Thresholds(0.6, 0.5, 0.2))
    assert "text" not in decided.columns
    assert [(r.decision, r.review_required) for r in decided.collect()] == [
        ("ALLOW", False), (None, False), (None, False), (None, False), ("ESCALATE", True)
    ]


def test_texts_are_scored_and_moderated_on_a_stream(spark, tmp_path):
    import pandas as pd

    from gavelspark.operators.model import predict_with

    rows = [(1, "a calm text", "r1"), (2, "a bad text", "r2"), (3, "an odd text", "r3")]
    frame = spark.createDataFrame(rows, "id int, text string, content_reference string")
    folder = folder_of(tmp_path, "requests", [frame])

    def predictor(texts):
        reject = texts.str.contains("bad").astype(float) * 0.8 + 0.05
        allow = texts.str.contains("calm").astype(float) * 0.9
        return pd.DataFrame({"p_allow": allow, "p_escalate": 1 - allow - reject, "p_reject": reject})

    scored = predict_with(
        stream_table(spark, folder, "requests"), predictor, keep=("id", "text", "content_reference")
    )
    decided = write_available(mo.moderate(scored, model_id="m", thresholds=Thresholds(0.6, 0.5, 0.2)), "texts")
    assert "text" not in decided.columns
    assert {r.id: r.decision for r in decided.collect()} == {1: "ALLOW", 2: "REJECT", 3: "ESCALATE"}


def fold(events):
    """One event at a time, as a queue would."""
    state, rejected = {}, {}
    for seq, ts, case, kind, decision in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "enqueue" and case not in state:
            state[case] = ("pending", None)
        elif kind == "resolve" and state.get(case, ("", ""))[0] == "pending":
            state[case] = ("resolved", decision)
        else:
            rejected[case] = rejected.get(case, 0) + 1
    return {c: (*state.get(c, ("unknown", None)), rejected.get(c, 0)) for c in {e[2] for e in events}}


EVENT = "seq long, ts timestamp, case_id string, kind string, reviewer_decision string"


def random_events(seed, n=400):
    rng = random.Random(seed)
    events = []
    for i in range(n):
        # A third of all events are about one case, and times repeat.
        case = "hot" if rng.random() < 0.34 else f"c{rng.randint(0, 60)}"
        kind = rng.choice(["enqueue", "resolve"])
        events.append((i, at(rng.randint(0, 90)), case, kind, rng.choice(["ALLOW", "REJECT"]) if kind == "resolve" else None))
    return events


@pytest.mark.parametrize("seed, split", [(1, 10_000_000), (2, 10_000_000), (3, 7), (4, 20)])
def test_review_queue_equals_a_sequential_fold(spark, seed, split, monkeypatch):
    monkeypatch.setattr(mo, "SPLIT_EVENTS", split)
    events = random_events(seed)
    queue = mo.review_queue(spark.createDataFrame(events, EVENT), keep_unknown=True)
    assert {r.case_id: (r.status, r.reviewer_decision, r.rejected_events) for r in queue.collect()} == fold(events)


def test_review_queue_is_shuffled_once_and_takes_any_sequence(spark, tmp_path):
    spark.createDataFrame(random_events(5), EVENT).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    queue = mo.review_queue(log)
    rows = queue.collect()
    plan = queue._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 2 and "ReusedExchange" in plan
    named = log.withColumn("seq", F.format_string("%09d", "seq"))
    assert sorted(mo.review_queue(named).collect()) == sorted(rows)


def test_review_queue_from_a_stream_with_redeliveries(spark, tmp_path):
    events = sorted(random_events(9), key=lambda e: e[1])
    frames = [spark.createDataFrame(events[i : i + 100], EVENT) for i in range(0, 400, 100)]
    folder = folder_of(tmp_path, "events", [*frames, frames[-1]])
    log = write_available(mo.review_log(stream_table(spark, folder, "events", max_files=1)), "log")
    queue = mo.review_queue(log, keep_unknown=True)
    assert {r.case_id: (r.status, r.reviewer_decision, r.rejected_events) for r in queue.collect()} == fold(events)
    pending = sum(v[0] == "pending" for v in fold(events).values())
    assert mo.pending_count(queue).first().pending == pending


def test_enqueue_and_resolve_once(spark):
    decided = spark.createDataFrame(
        [(1, at(0), "a", "ref", "m", "ESCALATE", True), (2, at(1), "b", "ref", "m", "ALLOW", False)],
        "seq long, ts timestamp, case_id string, content_reference string, model_id string, decision string, review_required boolean",
    )
    entries = mo.enqueue_events(decided)
    assert [r.case_id for r in entries.collect()] == ["a"]
    answers = spark.createDataFrame(
        [(3, at(2), "a", "resolve", "REJECT", "r1"), (4, at(3), "a", "resolve", "ALLOW", "r2")],
        "seq long, ts timestamp, case_id string, kind string, reviewer_decision string, reviewer_id string",
    )
    (row,) = mo.review_queue(entries.unionByName(answers, allowMissingColumns=True)).collect()
    assert (row.content_reference, row.model_id, row.proposed_decision) == ("ref", "m", "ESCALATE")
    assert (row.status, row.reviewer_decision, row.reviewer_id, row.rejected_events) == ("resolved", "REJECT", "r1", 1)


def test_latency_and_error_triggers(spark, log):
    rows, folder = log
    windows = write_available(mn.latency_windows(stream_table(spark, folder, "log", max_files=1), late="1 minute"), "lat")
    seen = windows.collect()
    for r in seen:
        inside = [x[3] for x in rows if r.window_start <= x[1] < r.window_start + dt.timedelta(minutes=15)]
        assert r.n == len(inside) and r.over == sum(v > 250 for v in inside)
    assert seen
    minutes = spark.createDataFrame([(at(0), 5), (at(1), 6), (at(2), 4), (at(3), 9), (at(5), 9), (at(6), 5), (at(7), 5)], "minute timestamp, errors long")
    assert sorted(r.alarm_at for r in mn.error_alarms(minutes).collect()) == [at(1), at(6), at(7)]


def test_rollback_verdict(spark):
    frame = spark.createDataFrame([(1,), (3,)], "x int")
    calm = mn.trigger(frame, "a", F.col("x") > 5)
    fired = mn.trigger(frame, "b", F.col("x") > 2)
    none = mn.trigger(frame.limit(0), "c", F.lit(True))
    assert tuple(mn.rollback_verdict([calm, none]).first()) == (False, "")
    assert tuple(mn.rollback_verdict([fired, calm, mn.trigger(frame, "aa", F.lit(True))]).first()) == (True, "aa,b")
