"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Each query runs once to warm up and once for the clock; every row of the result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile", "profile_summary", "numeric_summary", "distinct_counts", "duplicate_rows", "histogram", "correlation_matrix",
    "outliers_iqr", "by_target", "crosstab", "quality_score", "insights", "suggest_steps", "psi_numeric", "ks_two_sample",
    "detect_drift", "check_drift", "classification_metrics", "regression_metrics", "auc", "impute_median", "label_encode",
    "standard_scale", "run_steps", "preprocess_for_training", "sanitize", "validate_records", "point_in_time_join",
    "latest_per_entity", "rolling_performance", "trend_resample", "ab_results", "best_run", "deployment_states",
    "latency_percentiles", "sliding_window_limit", "chain_verify", "page_hinkley", "incremental_counters",
    "train_regression_linear", "batch_inference_deduplicated",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from tablewright import catalog
    from tablewright.session import build_session
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
        seconds[name] = round(took, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
