"""Streams over files, drained with availableNow, against their batch twins."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from entityops.plans.views import Tables
from entityops.streaming import operators as X

START = dt.datetime(2024, 1, 1)


def drain(spark, tmp_path, df, mode, name):
    stream = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert stream.exception() is None
    return spark.table(name)


def feed(spark, tmp_path, batches, ddl):
    """A file per batch, read one per trigger and in order."""
    folder = tmp_path / "in"
    for n, rows in enumerate(batches):
        part = folder / f"b{n:02d}"
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(part))
        for file in part.iterdir():
            os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_run_state_ignores_unknown_runs_and_bad_frames(spark, tmp_path):
    ddl = "run_id string, ordinal long, ts timestamp, type string"
    batches = [
        [("a", 1, at(0), "RUN_STARTED"), ("a", 2, at(1), "STEP_FINISHED"), ("x", 3, at(1), "RUN_STARTED")],
        [("a", 4, at(2), "TOOL_CALL_START"), ("b", 5, at(3), "STEP_FINISHED"), ("a", 6, at(4), "NOISE"), ("a", 7, at(5), "RUN_FINISHED")],
    ]
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    stream = X.run_state(feed(spark, tmp_path, batches, ddl), runs)
    got = {r.run_id: (r.status, r.stage_count, r.tool_call_count) for r in drain(spark, tmp_path, stream, "complete", "runs_out").collect()}
    assert got == {"a": ("done", 1, 1), "b": ("pending", 1, 0)}


def test_sessions_expire_a_fixed_time_after_creation(spark, tmp_path):
    ddl = "session_id string, ts timestamp"
    batches = [[("a", at(5)), ("a", at(0))], [("b", at(50)), ("a", at(58))], [("c", at(100))], [("c", at(200))]]
    stream = X.expired_sessions(feed(spark, tmp_path, batches, ddl), 3600, "1 minute")
    got = {r.session_id: (r.created_at, r.expires_at) for r in drain(spark, tmp_path, stream, "append", "expired_out").collect()}
    assert got["a"] == (at(0), at(60)) and got["b"] == (at(50), at(110))
    assert set(got) <= {"a", "b", "c"}


def test_late_ratings_are_dropped(spark, tmp_path):
    ddl = "ts timestamp, country string, connector string, rating string"
    batches = [[(at(0), "IN", "c", "not_helpful")] * 8, [(at(60 * 48), "IN", "c", "helpful")], [(at(60 * 49), "IN", "c", "helpful")], [(at(1), "IN", "c", "helpful")] * 5, [(at(60 * 96), "IN", "c", "helpful")]]
    stream = X.rolling_feedback(feed(spark, tmp_path, batches, ddl), "1 day", "1 hour")
    got = {r.window_start: (r.samples, r.negative, r.hint) for r in drain(spark, tmp_path, stream, "append", "feedback_out").collect()}
    assert got[START] == (8, 8, True)


def test_duplicate_uploads_within_the_watermark(spark, tmp_path):
    ddl = "doc_id long, ts timestamp, body string"
    batches = [[(1, at(0), "x"), (2, at(1), "y")], [(3, at(2), "x"), (4, at(3), "z")]]
    stream = X.dedup_uploads(feed(spark, tmp_path, batches, ddl), F.col("body"))
    assert sorted(r.body for r in drain(spark, tmp_path, stream, "append", "uploads_out").collect()) == ["x", "y", "z"]


@pytest.mark.parametrize("name", ["usage", "stages"])
def test_stream_equals_batch_on_whole_events(spark, tmp_path, name):
    t = Tables(spark, "/root/testdata/sf0.001")
    base = t.v_generations() if name == "usage" else t.events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("ordinal"))
    folder = str(tmp_path / "whole")
    base.repartition(3).write.parquet(folder)
    build = X.usage_by_day if name == "usage" else X.stage_counts
    stream = build(spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    got = drain(spark, tmp_path, stream, "complete", f"{name}_out")
    assert sorted(str(r).replace("Timestamp", "") for r in got.collect()) == sorted(map(str, build(base).collect()))
