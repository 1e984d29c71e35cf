"""Options of a bundle: shuffled once as lines, joined and numbered where they lie."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from entityops.functions.ordering import join_within, number_groups
from entityops.operators import adjudicate as A

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name",
    ["agg_13_field_verdicts", "set_4_superseded_except", "flt_8_clear_preselect", "agg_14_bundle_summary", "win_1_freshness_rank", "agg_15_audit_trail", "prj_19_guard_suggestions",
     "set_1_merge_plan_options", "set_1_merge_plan_conflicts", "win_7_first_seen"],
)
def test_wide_rows_are_not_shuffled(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with redirect_stdout(out):
            entry.queries()[name](spark, SF_DIR).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in out.getvalue().splitlines() if " Exchange " in line]
    assert exchanges and all("orderkey" in line for line in exchanges)


def test_join_within_is_an_equi_join(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, None, 3), (2, "a", 4), (None, "a", 5)], "k int, p string, v int")
    right = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (1, None, "z"), (None, "a", "w")], "k int, p string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = {(r.v, r.asDict().get("w")) for r in join_within(left, right, ["k", "p"], how).collect()}
        want = {(r.v, r.asDict().get("w")) for r in left.join(right, ["k", "p"], how).collect()}
        assert got == want


def test_number_groups_small_and_large(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("v")).where("g < 2 OR v < 30")
    for most in (1000, 50):
        got = number_groups(rows, ["g"], [F.col("v")], "n", sizes=rows, most=most).collect()
        assert sorted((r.g, r.v, r.n) for r in got) == sorted((r.g, r.v, r.v // 3 + 1) for r in got) and len(got) == 210


def test_paths_do_not_deal_options(spark):
    """Few paths would make few tasks: bindings and document types are broadcast."""
    for name in ("prj_1_flatten_options", "jn_11_path_to_logical"):
        out = io.StringIO()
        with redirect_stdout(out):
            entry.queries()[name](spark, SF_DIR).explain()
        assert "SortMergeJoin" not in out.getvalue() and "ShuffledHashJoin" not in out.getvalue()


def test_adjudication_writes_no_options(spark, monkeypatch):
    """Every option and check of a run, written to the checkpoint folder, would take many times the input."""
    written = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "checkpoint", lambda df, eager=True: written.append(df.columns) or df)
    monkeypatch.setattr(kind, "localCheckpoint", lambda df, *a, **b: written.append(df.columns) or df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with redirect_stdout(out):
            entry.queries()["job_1_adjudicate_verdicts"](spark, SF_DIR).explain()
        entry.queries()["job_1_adjudicate_checks"](spark, SF_DIR)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in out.getvalue().splitlines() if " Exchange " in line]
    assert not written
    assert exchanges and all("orderkey" in line or "path" in line.split("Exchange")[1][:30] for line in exchanges)


def test_verdicts_of_null_bundles_and_given_winners(spark):
    """A null bundle meets no conflict and no check; a conflict without a given winner still takes its path."""
    ddl = "bundle_id string, path string, label string, logical_id string, value string, confidence double, pre_selected boolean, needs_resolution string, ordinal string, option_key string"
    rows = [
        ("b", "p", "P", "x", "1", 0.9, True, None, "1", "k1"), ("b", "p", "Q", "x", "2", 0.9, True, None, "2", "k2"),
        ("b", "q", "R", "x", "1", 0.9, True, None, "3", "k3"), ("b", "r", "S", "x", "1", 0.9, True, None, "4", "k4"),
        (None, "p", "N", "x", "1", 0.9, True, None, "5", "k5"), (None, "p", "N", "x", "2", 0.9, None, "cityCode", "6", "k6"),
    ]
    options = spark.createDataFrame(rows, ddl)
    conflicts = spark.createDataFrame(
        [("b", "p", "P", "1", "k1", "1"), ("b", "r", "S", "4", "k4", "1"), (None, "p", "N", "5", "k5", "1")],
        "bundle_id string, path string, label string, ordinal string, winner_option_key string, winner_value string",
    )
    checks = spark.createDataFrame(
        [("b", "c", "fail", "block", "q", "x", "", "1"), ("b", "c", "fail", "block", "none", "x", "", "2"), (None, "c", "fail", "block", "p", "x", "", "3")],
        ", ".join(f"{c} string" for c in A.CHECK_COLUMNS),
    )
    winners = spark.createDataFrame([("b", "p", "k2", "2")], "bundle_id string, path string, winner_option_key string, winner_value string")
    common = {("b", "q", "R", "reject", None, "2-1"), (None, "p", "N", "accept", "k5", "3-5"), (None, "p", "N", "suggest", "k6", "3-6")}
    own = {tuple(r) for r in A.field_verdicts(options, conflicts, checks).collect()}
    assert own == common | {("b", "p", "P", "steward_required", "k1", "1-1"), ("b", "r", "S", "steward_required", "k4", "1-4"), (None, "p", "N", "steward_required", "k5", "1-5")}
    given = {tuple(r) for r in A.field_verdicts(options, conflicts, checks, winners).collect()}
    assert given == common | {("b", "p", "P", "steward_required", "k2", "1-1")}
