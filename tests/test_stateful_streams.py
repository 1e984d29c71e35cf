"""Streams with keyed state against their batch twins, batch by batch."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import at, drain, feed

from entityops.sources import keyed
from entityops.streaming import stateful as S

DAY = 24 * 60


@pytest.fixture(autouse=True)
def store(spark):
    S.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def last_rows(table, key):
    return {r[key]: tuple(r) for r in table.collect()}  # the memory sink keeps rows in the order of batches


def test_runs_expire_ninety_days_after_their_creation(spark, tmp_path):
    ddl = "run_id string, ordinal long, ts timestamp, type string"
    batches = [
        [("a", 2, at(5), "RUN_STARTED"), ("a", 1, at(0), "RUN_CREATED"), ("x", 3, at(1), "RUN_STARTED"), ("b", 4, at(9), "RUN_CREATED"), ("a", 0, at(1), "STEP_FINISHED")],
        [("a", 5, at(DAY), "STEP_FINISHED"), ("b", 6, at(DAY), "NOISE"), ("c", 7, at(89 * DAY), "RUN_CREATED"), ("a", 8, at(89 * DAY), "TOOL_CALL_START"), ("a", 9, at(91 * DAY), "STEP_FINISHED")],
        [("c", 10, at(92 * DAY), "RUN_STARTED")],
        [("c", 12, at(93 * DAY), "RUN_FINISHED")],
        [("a", 13, at(94 * DAY), "RUN_FINISHED"), ("c", 11, at(80 * DAY), "STEP_FINISHED")],  # of a run that is gone, and late
    ]
    out = drain(spark, tmp_path, S.expiring_runs(feed(spark, tmp_path, batches, ddl)), "update", "runs_state")
    got = last_rows(out, "run_id")
    assert set(got) == {"a", "b", "c"}
    assert got["a"][1:] == ("expired", 1, 1, at(89 * DAY), at(90 * DAY)) and got["b"][1:4] == ("expired", 0, 0)
    assert got["c"][1:5] == ("done", 0, 0, at(93 * DAY))
    assert [r.status for r in out.where("run_id = 'a'").collect()].count("expired") == 1
    state = spark.read.format("statestore").option("path", str(tmp_path / "ck_runs_state")).option("stateVarName", "run").load()
    assert [r.key.run_id for r in state.collect()] == ["c"]  # the others left no state behind


def test_runs_in_order_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    ddl = "run_id string, ordinal long, ts timestamp, type string"
    kinds = ["RUN_CREATED", "RUN_STARTED", "STEP_FINISHED", "TOOL_CALL_START", "RUN_FINISHED", "NOISE"]
    rows = [(f"r{rng.randrange(12)}", k, at(30 * k), rng.choice(kinds)) for k in range(900)]
    batches = [rows[k : k + 150] for k in range(0, 900, 150)]
    out = drain(spark, tmp_path, S.expiring_runs(feed(spark, tmp_path, batches, ddl), "12 days", "1 minute"), "update", "runs_random")
    twin = last_rows(S.expiring_runs(spark.createDataFrame(rows, ddl), "12 days"), "run_id")
    got = last_rows(out, "run_id")
    # a stream may create a run again once it is gone; those rows are of its second life
    first = {k: v for k, v in got.items() if v[5] == twin[k][5]}
    assert set(got) == set(twin) and first and all(v == twin[k] for k, v in first.items())


def test_copies_leave_with_the_id_they_repeat(spark, tmp_path):
    ddl = "doc_id long, ts timestamp, body string"
    batches = [[(2, at(1), "x"), (1, at(0), "x"), (3, at(2), "y")], [(4, at(3), "x"), (5, at(4), "z"), (6, at(4), "z")], [(7, at(3 * DAY), "w")], [(8, at(3 * DAY + 1), "x")], [(9, at(3 * DAY + 2), "x")]]
    out = drain(spark, tmp_path, S.first_uploads(feed(spark, tmp_path, batches, ddl), F.col("body")), "append", "firsts")
    got = {int(r.id): (int(r.first_id), r.is_duplicate) for r in out.collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (1, True), 5: (5, False), 6: (5, True), 7: (7, False), 8: (8, False), 9: (8, True)}


def test_first_ids_equal_those_of_the_batch(spark, tmp_path):
    rng = random.Random(9)
    ddl = "doc_id long, ts timestamp, body string"
    rows = [(k, at(k), rng.choice("abcdefghijk") * (1 if rng.random() < 0.7 else k)) for k in range(300)]
    stream = S.first_uploads(feed(spark, tmp_path, [rows[k : k + 60] for k in range(0, 300, 60)], ddl), F.col("body"))
    table = spark.createDataFrame(rows, ddl)
    want = {r.doc_id: (r.first_id, r.is_duplicate) for r in keyed.exact_duplicates(table, "doc_id", "body").collect()}
    for found in (drain(spark, tmp_path, stream, "append", "firsts_random"), S.first_uploads(table, F.col("body"))):
        assert {int(r.id): (int(r.first_id), r.is_duplicate) for r in found.collect()} == want


def test_hints_after_each_batch_are_those_of_the_last_ratings(spark, tmp_path):
    rng = random.Random(6)
    ddl = "country string, rating string, connector_ids array<string>, ts timestamp, ordinal long"
    names = ["c1", "c2", "c3"]
    rows = [(rng.choice(["IN", "DE", None]), rng.choice(["not_helpful", "helpful", "helpful", None, " "]), rng.choice([[rng.choice(names)], names, [], None]), at(rng.randrange(400)), k) for k in range(400)]
    batches = [rows[k : k + 100] for k in range(0, 400, 100)]
    out = drain(spark, tmp_path, S.last_feedback_hints(feed(spark, tmp_path, batches, ddl), names, recent=40), "update", "hints").collect()
    at_once, seen = 9, []  # three rows for each of three countries and batch
    assert len(out) == at_once * len(batches)
    for k, batch in enumerate(batches):
        seen += batch
        want = sorted(map(str, S.last_feedback_hints(spark.createDataFrame(seen, ddl), names, recent=40).collect()))
        assert sorted(map(str, out[at_once * k : at_once * (k + 1)])) == want
    assert any(r.subject for r in out)
