"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from entityops.plans import catalog, views
from entityops.session import local_session

HEADLINE = [
    "job_1_lite_conflicts_with_freshness", "agg_7_detect_conflicts", "win_1_freshness_rank", "agg_13_field_verdicts", "flt_7_auto_apply", "prj_1_flatten_options",
    "agg_1_effective_state", "job_3_apply_ruleset", "src_11_import_rules", "agg_16_integrity_audit", "jn_3_match_reference", "agg_2_overall_weighted", "agg_6_trust_score",
    "set_3_apply_patches", "agg_17_classify_corpus", "prj_18_page_signals", "src_7_exact_duplicates", "agg_8_usage_summary", "jn_5_score_pairs", "jn_13_duplicate_candidates",
]


WIDE = {"lineitem", "orders", "part", "events", "documents", "pages"}


def spread_single_files() -> None:
    """The bench tables are one file with one row group each; deal their rows to all cores, as a stored table would be."""
    read = views.Tables.__getattr__

    def dealt(self, name):
        table = read(self, name)
        return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if name in WIDE else table

    views.Tables.__getattr__ = dealt


def run(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores=cores, memory="16g")
    spread_single_files()
    seconds = {}
    run(catalog.QUERIES["agg_1_effective_state"], spark, sf_dir)  # warms the session, not each query
    for name in names:
        query = catalog.QUERIES[name]
        seconds[name] = round(statistics.median(run(query, spark, sf_dir) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
