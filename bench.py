"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion through the ``noop`` sink (no collect).  Each
query is built and run twice in the same session: ``queries`` / ``value`` are
the second (warm: JIT and code generation done) runs, ``cold_queries`` the
first runs, so both numbers are visible.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "matrix_shape",
    "feature_std",
    "constant_count",
    "chi2_score",
    "topk_anova",
    "selectkbest_chi2",
    "gather_selected",
    "target_encode",
    "split_stratified",
    "metric_auc",
    "logreg_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from featsift.plans.catalog import QUERIES
    from featsift.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="featsift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["metric_accuracy"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times, cold = {}, {}
    for name in HEADLINE:
        for run in (cold, times):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            run[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_sec_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold_queries": cold,
        "cold_value": round(sum(cold.values()), 3),
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
