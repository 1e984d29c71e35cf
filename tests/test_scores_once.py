"""Scores of pairs: each measure is computed once, and all different pairs of a batch together."""

import io
import random
from contextlib import redirect_stdout

import pyarrow as pa

import __spark_entry__ as entry
from entityops.functions import text as T
from entityops.operators import match as M

SF_DIR = "/root/testdata/sf0.001"


def shown(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_ranking_scores_candidates_once(spark):
    assert shown(entry.queries()["win_4_rank_candidates"](spark, SF_DIR)).count("ArrowEvalPython") == 1


def test_texts_of_a_candidate_are_reduced_and_sorted_once(spark):
    plan = shown(entry.queries()["agg_21_score_address_candidates"](spark, SF_DIR))
    assert plan.count("[^a-z0-9]") == 2 and plan.count("sort_array") + plan.count("array_sort") <= 8


def test_texts_are_in_normal_form_before_they_are_paired(spark):
    plan = shown(entry.queries()["jn_5_score_pairs"](spark, SF_DIR))
    scoring = plan[: plan.index("Join")]
    assert "ArrowEvalPython" in scoring and "regexp_replace" not in scoring and "regexp_replace" in plan


def test_pairs_are_scored_alike_whenever_their_texts_are_prepared(spark):
    left = "id int, name string, legal_name string, tax_ids array<string>, city string, street string, postal_code string, country string"
    right = "id int, found_name string, found_legal_name string, found_tax_id string, found_city string, found_street string, found_postal_code string, found_country string"
    a = spark.createDataFrame([(1, "Acme", None, ["T-1", "N 2"], "東京", " ", "p 1", "de"), (2, None, "Acme Ltd", None, "Bonn", "Main road", None, None)], left)
    b = spark.createDataFrame([(1, None, "ACME ltd", "n2", "東京", "Main st", "P-1", "DE"), (2, "", " ", None, "bonn", "road main", "1", "fr")], right)
    late = M.score_pairs(a.join(b, "id"), ["id"])
    early = M.score_pairs(M.left_texts(a).join(M.right_texts(b), "id"), ["id"])
    rows = sorted(map(tuple, late.collect()), key=str)
    assert rows == sorted(map(tuple, early.collect()), key=str) and len(rows) == 12
    found = {(r.id, r.field): (r.score, r.status, r.skip_reason) for r in late.collect()}
    assert found[1, "street"] == (0, "unknown", "missing left") and found[2, "tradingName"] == (0, "unknown", "missing left")
    assert found[1, "city"] == (0, "mismatch", None) and found[1, "postalCode"] == (100, "match", None) and found[2, "city"] == (100, "match", None)
    assert found[2, "tax"] == (0, "unknown", "missing left") and found[2, "country"] == (0, "unknown", "missing left")


def test_ratio_of_a_batch_is_the_ratio_of_each_pair(spark):
    rng = random.Random(3)

    def made():
        return None if rng.random() < 0.05 else "".join(rng.choice("abcdé東\U0001f600\0 ") for _ in range(rng.choice([0, 1, 5, 16, 63, 64, 65, 90])))

    left = [made() for _ in range(2000)]
    right = [x if rng.random() < 0.1 else made() for x in left]
    got = T._similarity_udf.func(pa.array(left, pa.string()), pa.array(right, pa.string())).to_pylist()
    assert got == [None if a is None or b is None else T._similarity(a, b) for a, b in zip(left, right)]
