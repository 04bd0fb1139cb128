"""Time the headline queries: one JSON line on the last line of stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs whole, into a sink
that discards its rows, BENCH_RUNS times (2); the shorter time counts, so that one-off class
loading and code generation do not.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.plans.catalog import QUERIES  # noqa: E402
from cohortlens.session import local_session  # noqa: E402

HEADLINE = [
    "churn_label",
    "lag_features",
    "variation",
    "panel_presence",
    "ratio_features",
    "ntile_features",
    "ntile_features_wide",
    "rank_family",
    "undersample",
    "stratified_split",
    "kfold_assign",
    "repeated_splits",
    "psi_feature",
    "psi_all",
    "describe_numeric",
    "column_profile",
    "gain_curve",
    "best_cutoff",
    "public_private_curve",
    "cutoff_submissions",
    "seed_band",
    "wilcoxon_stat",
    "importance_mean",
    "gbt_scores",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {
        name: round(min(run(spark, name, sf_dir) for _ in range(runs)), 3) for name in names
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
