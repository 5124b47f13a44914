"""Time every query into a no-op sink and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed
runs per query after one warm-up; the median counts), BENCH_ONLY (comma-separated
query names).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from martlens.plans import catalog
from martlens.session import drop_written, local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
ONLY = [name for name in os.environ.get("BENCH_ONLY", "").split(",") if name]

# One fit (or six) takes longer than all other queries together.
SINGLE_RUN = {"rf_train_metrics", "cv_auc", "feature_importance", "churn_predictions"}


def timed(query, spark) -> float:
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session("martlens-bench", CPUS)
    queries = catalog.queries()
    seconds = {}
    for name, query in queries.items():
        if ONLY and name not in ONLY:
            continue
        if name in SINGLE_RUN:
            seconds[name] = round(timed(query, spark), 3)
            continue
        timed(query, spark)
        seconds[name] = round(statistics.median(timed(query, spark) for _ in range(RUNS)), 3)
    drop_written(spark)
    spark.stop()
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
