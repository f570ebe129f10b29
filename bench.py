"""Time every query on local cores and print one JSON line.

BENCH_SF_DIR   folder of Parquet tables   (default /root/testdata/sf0.1)
BENCH_CPUS     local cores                (default 8)
BENCH_RUNS     timed runs after one warm  (default 3; the median counts)
BENCH_QUERIES  comma-separated names      (default: all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.queries import QUERIES
from tidemark.session import local_session


def seconds(spark, query, sf_dir: str) -> float:
    """Plan and run a query in full; the rows are produced and thrown away."""
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or sorted(QUERIES)
    spark = local_session("bench", cores, cores, **{"spark.driver.memory": "8g"})
    timings = {}
    for name in names:
        seconds(spark, QUERIES[name], sf_dir)
        timings[name] = round(statistics.median(
            seconds(spark, QUERIES[name], sf_dir) for _ in range(runs)), 3)
        print(f"{name:28s} {timings[name]:8.3f}", file=sys.stderr)
    spark.stop()
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
