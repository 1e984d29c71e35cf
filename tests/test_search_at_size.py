"""Duplicate search on large groups: no broadcasts of tables with a row for every record, and no needless questions."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

import __spark_entry__ as entry
from entityops.operators import duplicates as D
from entityops.operators import match as M

SF_DIR = "/root/testdata/sf0.001"


def shown(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_search_broadcasts_nothing(spark):
    assert "BroadcastExchange" not in shown(entry.queries()["jn_13_search_duplicates"](spark, SF_DIR))


def test_sets_that_earn_less_are_not_asked_and_nothing_is_lost(spark):
    """All groups are large; every score from name to address occurs."""
    rows = spark.range(240).select(
        F.col("id").alias("record_id"), F.concat(F.lit("alpha beta "), F.element_at(F.array(F.lit("gamma"), F.lit("delta"), F.lit("beta")), (F.col("id") % 3 + 1).cast("int"))).alias("name"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 2).cast("string")).alias("country"), (F.col("id") % 7).cast("string").alias("postal_code"),
        F.when(F.col("id") % 4 != 0, (F.col("id") % 11).cast("string")).alias("street"), F.when(F.col("id") % 3 != 0, F.lit("x")).alias("city"),
    )
    taxes = spark.range(240).where("id % 6 <> 0").select(F.col("id").alias("record_id"), F.concat(F.lit("T"), (F.col("id") % 9).cast("string")).alias("number"))
    got = {s: sorted(map(tuple, D.search_duplicates(rows, taxes, small_group=s).collect()), key=str) for s in (2, 1000)}
    assert got[2] == got[1000] and len(got[2]) == 240 * 5


def test_fields_that_agree_earn_the_score(spark):
    one = spark.createDataFrame([("a", "de", "1", "s", "c", ["t"])], "name string, country string, postal string, street string, city string, tax array<string>")
    score = lambda points, mask, tax: one.select(D._earned(F.lit(points), F.lit(mask), F.lit(tax))).first()[0]
    assert score(100, 15, True) == 100 and score(0, 0, False) == 0 and score(0, 12, False) == 30 and score(50, 2, True) == 50


def test_candidates_are_dealt_by_the_number_of_questions(spark, monkeypatch):
    before = sorted(map(tuple, entry.queries()["jn_13_duplicate_candidates"](spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(M, "QUESTIONS_PER_PART", 100)
    df = entry.queries()["jn_13_duplicate_candidates"](spark, "/root/testdata/sf0.01")
    plan = shown(df)
    parts = max(int(n) for n in re.findall(r"hashpartitioning\(b#\d+L?(?:, [a-z]1#\d+)*, (\d+)\)", plan))
    assert "BroadcastExchange" not in plan and parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, df.collect())) == before
