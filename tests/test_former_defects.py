"""One small case for each defect that green queries once hid."""

from entityops.functions.ordering import padded
from entityops.operators import adjudicate as A
from entityops.operators import match, project, resolve, usage
from entityops.sources import keyed, uploads
from pyspark.sql import functions as F


def test_later_patch_on_a_parent_drops_an_earlier_child(spark):
    records = spark.createDataFrame([(1, "a.x", "old"), (1, "b", "keep"), (2, "a.x", "other")], "record_id int, path string, value string")
    patches = spark.createDataFrame(
        [(1, "a.b", "child", 1), (1, "a", "whole", 2), (1, "c", "first", 1), (1, "c.d", "later", 2)], "record_id int, path string, value string, ordinal int"
    )
    got = {(r.record_id, r.path, r.value) for r in resolve.apply_patches(records, patches).collect()}
    assert got == {(1, "a", "whole"), (1, "b", "keep"), (1, "c", "first"), (1, "c.d", "later"), (2, "a.x", "other")}


def test_numbers_as_text_sort_by_value(spark):
    rows = spark.createDataFrame([(n,) for n in (9, 10, 999, 9999, 10000, 123456, 12345)], "n int")
    assert [r.n for r in rows.orderBy(padded(F.col("n"), 4)).collect()] == [9, 10, 999, 9999, 10000, 12345, 123456]


def test_missing_type_still_warns(spark):
    options = spark.createDataFrame([(1, "p", "l", "X", "1")], "bundle_id int, path string, label string, value string, ordinal string")
    master = spark.createDataFrame([(1, "p", "Y", None)], "bundle_id int, path string, value string, value_type string")
    assert A.compare_to_master(options, master).count() == 1


def test_mismatch_clears_and_rejects_both_identifiers(spark):
    fields = "bundle_id int, logical_id string, path string, value string, ordinal string, label string, pre_selected boolean, needs_resolution string, option_key string, confidence double"
    rows = [
        (1, "gstin", "tax.3", "29ABCPD1234F1Z5", "1", "g", True, None, "g1", 0.9),
        (1, "pan", "tax.4", "ABCPD9999F", "2", "p", True, None, "p1", 0.9),
        (1, "pan", "tax.5", "ABCPD9999F", "3", "p", True, None, "p2", 0.9),
        (2, "gstin", "tax.3", "29ABCPD1234F1Z5", "1", "g", True, None, "g3", 0.9),
        (2, "pan", "tax.4", "ABCPD1234F", "2", "p", True, None, "p3", 0.9),
    ]
    options = spark.createDataFrame(rows, fields)
    checks = A.bundle_checks(options, {"pan": "pan", "gstin": "gstin"})
    failed = A.check_targets(options, checks).where("status = 'fail'").collect()
    assert {(r.bundle_id, r.path, r.logical_id) for r in failed} == {(1, "tax.3", "gstin"), (1, "tax.4", "pan")}
    cleared = {r.option_key: r.pre_selected for r in A.clear_preselect(options, checks).collect()}
    assert cleared == {"g1": False, "p1": False, "p2": False, "g3": True, "p3": True}
    none = spark.createDataFrame([], "bundle_id int, path string, label string, ordinal string")
    winners = spark.createDataFrame([], "bundle_id int, path string, winner_option_key string, winner_value string")
    verdicts = A.field_verdicts(options, none, checks, winners).where("action = 'reject'").collect()
    assert {(r.bundle_id, r.path) for r in verdicts} == {(1, "tax.3"), (1, "tax.4")}


def test_names_of_any_script_are_found(spark):
    names = ["东方贸易公司", "东方贸易公司", "Société Générale", "société générale", "Other Firm"]
    records = spark.createDataFrame([(i, n, "C", "1") for i, n in enumerate(names)], "record_id int, name string, country string, postal_code string")
    got = {(r.record_id, r.candidate_id) for r in match.duplicate_candidates(records).collect()}
    assert got == {(0, 1), (1, 0), (2, 3), (3, 2)}


def test_long_ids_are_compared_whole(spark):
    long = "x" * 130
    raw = spark.createDataFrame([("g", long + "1", "same", "r" * 300, 1), ("g", long + "2", "different", "", 2)], "grp string, id string, verdict string, reason string, ordinal int")
    known = spark.createDataFrame([("g", long + "2", 1)], "grp string, id string, ordinal int")
    verdicts, _ = project.guard_verdicts(raw, known, "grp")
    assert [(r.id, r.verdict) for r in verdicts.collect()] == [(long + "2", "different")]
    cut, _ = project.guard_verdicts(raw, known.withColumn("id", F.lit(long + "1")), "grp", reason_length=200)
    assert len(cut.first().reason) == 200


def test_limits_are_those_asked_for(spark):
    rows = spark.range(300).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("x").alias("name"), F.lit("m").alias("model"),
        F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(0.1).alias("cost"),
    )
    assert usage.recent_generations(rows, 250).count() == 250


def test_refused_changes_claim_nothing_and_deleted_keys_are_free(spark):
    table = spark.createDataFrame([(1, "A"), (2, "B")], "id int, k string")
    changes = spark.createDataFrame([("update", 9, "new", 1), ("insert", 3, "new", 2), ("delete", 2, None, 3), ("insert", 4, "b", 4), ("insert", 5, "a", 5)], "op string, id int, k string, ordinal int")
    after, refused = keyed.apply_changes(table, changes, "id", ["k"])
    assert {(r.id, r.k) for r in after.collect()} == {(1, "A"), (3, "NEW"), (4, "B")}
    assert {(r.id, r.reason) for r in refused.collect()} == {(9, "unknown row"), (5, "key taken")}


def test_first_copy_follows_the_order(spark):
    rows = spark.createDataFrame([(1, "t", 5), (2, "t", 3), (3, "u", 1)], "id int, text string, at int")
    got = {r.id: r.first_id for r in keyed.exact_duplicates(rows, "id", "text", order="at").collect()}
    assert got == {1: 2, 2: 2, 3: 3}


def test_large_files_are_judged_by_their_length(spark, tmp_path):
    (tmp_path / "big.pdf").write_bytes(b"%PDF-" + b"x" * 5000)
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-1.7")
    got = {r.path.rsplit("/", 1)[-1]: r.status for r in uploads.upload_scan(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got == {"big.pdf": 413, "ok.pdf": 200}
