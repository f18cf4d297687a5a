"""Streams read from files until nothing is left."""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime, timedelta

from verity.plans.runner import stub_scorer
from verity.streaming import snapshots as streams


def drained(stream, tmp_path, mode="append"):
    name = f"q{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_calls_finish_over_batches(spark, tmp_path):
    kind = "traj string, tool_call_id string, idx int, title string, status string"
    spark.createDataFrame([("t", "a", 0, "Run", "pending"), ("t", "b", 1, "", "pending")], kind).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("t", "a", 2, "", "completed"), ("u", "a", 0, "Other", "failed")], kind).write.parquet(str(tmp_path / "in" / "2"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in drained(streams.finished_calls(source), tmp_path))
    assert [(r[0], r[1], r[3]) for r in got] == [("t", "a", "completed"), ("u", "a", "failed")]
    assert got[1][2:] == ("Other", "failed", 1)


def test_windows_and_sessions(spark, tmp_path):
    events = spark.sql("select timestamp_seconds(60 * id) as ts, id % 2 as user_id, 'click' as event_type, 1.0D as value from range(30) union all select timestamp_seconds(100000), 9L, 'end', 0.0D")
    events.write.parquet(str(tmp_path / "events"))
    source = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    windows = drained(streams.event_windows(source()), tmp_path)
    assert sorted((r["n"], r["value"]) for r in windows if r["event_type"] == "click") == [(10, 10.0)] * 3
    sessions = drained(streams.event_sessions(source()), tmp_path)
    assert sorted((r["user_id"], r["n"]) for r in sessions if r["user_id"] < 9) == [(0, 15), (1, 15)]


def test_scoring_goes_on_where_it_stopped(spark, tmp_path):
    kind = "instance_id string, model string, ord int"
    source = lambda: spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, rows in enumerate(([("a", "m", 0), ("b", "m", 1)], [("c", "m", 2)], None)):
        if rows:
            spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in" / str(n)))
        streams.score_increments(source(), lambda: stub_scorer, out, state).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted(r["instance_id"] for r in got) == ["a", "b", "c"] and all(r["error"] is None and 0 <= r["confidence"] <= 1 for r in got)


def test_calls_without_an_end_are_given_up(spark, tmp_path):
    kind = "traj string, tool_call_id string, idx int, title string, status string"
    spark.createDataFrame([("t", "a", 0, "Run", "pending"), ("u", "b", 0, "", "completed")], kind).write.parquet(str(tmp_path / "in"))
    stream = streams.finished_calls(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), idle_ms=1)
    query = stream.writeStream.format("memory").queryName("given_up").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            if spark.table("given_up").count() == 2:
                break
    finally:
        query.stop()
    assert sorted((r["traj"], r["title"], r["status"]) for r in spark.table("given_up").collect()) == [("t", "Run", "unfinished"), ("u", "", "completed")]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_sessions_of_calls_by_batches(spark, tmp_path):
    kind = "traj string, tool_call_id string, idx long, title string, status string, ts timestamp"
    at = lambda minute: datetime(2026, 1, 1, tzinfo=UTC) + timedelta(minutes=minute)
    batches = [
        [("t", "a", 0, "Run", "pending", at(0)), ("t", "b", 1, "Never", "pending", at(1)), ("t", "c", 2, "", "pending", at(1))],
        [("t", "a", 0, "Run", "pending", at(0)), ("t", "a", 3, "", "completed", at(3)), ("t", "c", 4, "C", "failed", at(4))],  # the first is told twice
        [("t", "a", 5, "Again", "pending", at(5)), ("u", "z", 0, "", "completed", at(60))],
        [("u", "w", 0, "", "completed", at(61))],
        [("t", "a", 6, "", "completed", at(6)), ("t", "d", 1, "late", "completed", at(7)), ("u", "y", 0, "", "completed", at(200))],  # beyond the watermark
        [("u", "x", 0, "", "completed", at(400))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        got = sorted((r["traj"], r["tool_call_id"], r["title"], r["status"], r["snapshots"]) for r in drained(streams.call_sessions(source, 600_000, "10 minutes"), tmp_path))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert [g for g in got if g[0] == "t"] == [("t", "a", "Again", "unfinished", 1), ("t", "a", "Run", "completed", 2), ("t", "b", "Never", "unfinished", 1), ("t", "c", "C", "failed", 2)]
    table = spark.createDataFrame([r for rows in batches[:3] for r in rows], kind)
    plain = sorted((r["traj"], r["tool_call_id"], r["title"], r["status"], r["snapshots"]) for r in streams.call_sessions_of(table).collect())
    assert [g for g in plain if g[0] == "t"] == [g for g in got if g[0] == "t"]
