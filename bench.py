"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayframe.plans import profile as profile_plan  # noqa: E402
from assayframe.session import local_session  # noqa: E402
from registered import MODULES  # noqa: E402
from registered.fixtures import table  # noqa: E402

HEADLINES = [
    "assess", "domain_scores_long", "what_if_criteria", "cqi_from_scores", "profile_numeric_lineitem", "profile_by_group",
    "duplicates_all_columns", "profile_value_counts", "standards_detect", "metadata_violations", "dataset_history",
    "gap_panel", "score_delta", "k_anonymity", "pii_value_scan", "near_copies", "ref_integrity", "feature_corr",
    "lifecycle_latest", "throttle_60s", "stream_profile",
]


def _profile_lineitem(spark, sf_dir):
    return profile_plan.profile(table(spark, sf_dir, "lineitem"), "lineitem", "parquet").columns


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    queries = {n: fn for m in MODULES for n, fn in m.QUERIES.items()}
    todo = {"profile_lineitem_full": _profile_lineitem, **{n: queries[n] for n in HEADLINES}}
    spark = local_session("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name, fn in todo.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
