"""Row order, partitioning and skew must not change a result."""

import random

import pytest
from pyspark.sql import functions as F

from entityops.functions.ordering import first_row, last_row, number_rows, top_rows
from entityops.operators import adjudicate as A
from entityops.plans.views import Tables


def skewed(spark, n=3000):
    rng = random.Random(11)
    rows = [("hot" if i % 3 else f"k{i % 50}", i, rng.randint(0, 9)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, ordinal long, v int").repartition(7)


def test_numbering_of_a_hot_group(spark):
    rows, df = skewed(spark)
    got = {(r.key, r.ordinal): r.nth for r in number_rows(df, ["key"], [F.col("ordinal")], [F.floor(F.col("ordinal") / 100)], "nth").collect()}
    seen, want = {}, {}
    for key, ordinal, _ in sorted(rows, key=lambda r: r[1]):
        seen[key] = seen.get(key, 0) + 1
        want[key, ordinal] = seen[key]
    assert got == want


def test_numbering_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "key string, ordinal long")
    got = sorted((str(r.key), r.nth) for r in number_rows(df, ["key"], [F.col("ordinal")], [F.floor(F.col("ordinal") / 2)], "nth").collect())
    assert got == [("None", 1), ("None", 2), ("a", 1)]


def test_first_last_and_top(spark):
    rows, df = skewed(spark, 600)
    first = {r.key: r.ordinal for r in first_row(df, ["key"], [F.col("v"), F.col("ordinal")]).collect()}
    last = {r.key: r.ordinal for r in last_row(df, ["key"], [F.col("v"), F.col("ordinal")]).collect()}
    by_key = {}
    for key, ordinal, v in rows:
        by_key.setdefault(key, []).append((v, ordinal))
    assert first == {k: min(x)[1] for k, x in by_key.items()} and last == {k: max(x)[1] for k, x in by_key.items()}
    top = top_rows(df, ["key"], [F.col("v"), F.col("ordinal")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.rank, r.ordinal) for r in top.collect()} == {(k, i + 1, o) for k, x in by_key.items() for i, (_, o) in enumerate(sorted(x)[:3])}


@pytest.mark.parametrize("partitions", [1, 13])
def test_partitioning_does_not_matter(spark, partitions):
    options = Tables(spark, "/root/testdata/sf0.001").v_options()
    shuffled = options.orderBy(F.rand(5)).repartition(partitions)

    def rows(df):
        return sorted(map(str, df.collect()))

    assert rows(A.detect_conflicts(shuffled)) == rows(A.detect_conflicts(options))
    assert rows(A.freshness_rank(shuffled)) == rows(A.freshness_rank(options))


def test_conflicts_are_combined_before_the_shuffle(spark):
    plan = A.detect_conflicts(Tables(spark, "/root/testdata/sf0.001").v_options())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan
    assert "ReadSchema" in plan and "l_extendedprice" not in plan
