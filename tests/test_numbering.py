"""Numbers of every row by sampled ranges, and the integrity audit on nulls and joined keys."""

from collections import Counter

from pyspark.sql import functions as F

from entityops.functions.ordering import number_sorted
from entityops.operators import audit as AU
from entityops.operators import trust as U


def test_number_sorted_small_groups_nulls_and_ties(spark):
    rows = [("b", 2, "x"), ("a", 1, "y"), (None, 7, "p"), ("a", 1, "x"), (None, None, "q"), ("b", None, "z"), ("a", 1, "x")]
    df = spark.createDataFrame(rows, "g string, v long, t string").repartition(3)
    got = sorted((r.g or "", r.n, r.v if r.v is not None else -1, r.t) for r in number_sorted(df, ["g"], [F.col("v"), F.col("t")], "n").collect())
    assert got == [("", 1, -1, "q"), ("", 2, 7, "p"), ("a", 1, 1, "x"), ("a", 2, 1, "x"), ("a", 3, 1, "y"), ("b", 1, -1, "z"), ("b", 2, 2, "x")]
    assert number_sorted(df.where("false"), ["g"], [F.col("v")], "n").count() == 0


def test_a_group_with_a_third_of_all_rows_all_tied_is_spread(spark):
    """One record holds a third of the rows, all of one strength: every row gets its number, no range holds twice the median."""
    total = 60_000
    record = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 997).alias("record_id")
    scored = spark.range(total).select(
        record, F.xxhash64("id").alias("ordinal"), F.lit(50.0).alias("match_score"), F.lit(0.5).alias("authority"), F.col("id").alias("source_id")
    ).repartition(8)
    ranked = U.rank_sources(scored)
    hot = ranked.where("record_id = -1").orderBy("ordinal").select("rank").collect()
    assert [r["rank"] for r in hot] == list(range(1, total // 3 + 1))
    numbers = Counter((r.record_id, r["rank"]) for r in ranked.select("record_id", "rank").collect())
    assert len(numbers) == total and set(numbers.values()) == {1}
    ranges = scored.repartitionByRange(8, "record_id", -(F.col("match_score") * F.col("authority")), "ordinal")
    sizes = sorted(r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_integrity_audit_counts_every_kind_of_finding(spark):
    rows = [(1, "a", 5, "x", None), (1, "a", 6, "y", "k"), (2, None, None, "z", ""), (2, None, 9, "x", "k"), (3, "a|b", 9, None, "k")]
    df = spark.createDataFrame(rows, "k long, s string, ref int, code string, need string")
    reference = spark.createDataFrame([(5,), (None,)], "id long")
    other = spark.createDataFrame([("a",)], "s string")
    found = AU.integrity_audit(df, ["k", "s"], {"ref": (reference, "id"), "s": (other, "s")}, {"code": ["x"]}, {"code": "need"})
    assert sorted(map(tuple, found.select(*AU.FINDING).collect())) == [
        ("dangling_reference", "ref=6", 1), ("dangling_reference", "ref=9", 2), ("dangling_reference", "s=a|b", 1),
        ("duplicate_key", "1|a", 2), ("duplicate_key", "2", 2), ("inconsistent_columns", "code without need", 2),
        ("unknown_code", "code=y", 1), ("unknown_code", "code=z", 1),
    ]
    assert AU.integrity_audit(df.where("k = 3"), ["k"]).count() == 0
