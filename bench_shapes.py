"""What one pass saves: each check as a statement of its own, against this package.

The left column runs the obvious statements (a count, then one query per
expectation, two per parity check, a re-count after a write); the right column is
the operator that replaces them. Same session, same tables, median of three.
"""

from __future__ import annotations

import os
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality, recon
from tidemark.plans import tables
from tidemark.queries.parity import ORDER_CHECKS
from tidemark.session import local_session

CHECKS = (
    quality.not_null("l_orderkey"), quality.not_null("l_partkey"),
    quality.in_set("l_returnflag", ["A", "N"]), quality.non_negative("l_quantity"),
    quality.non_negative("l_extendedprice"),
    quality.Expectation("discount_small", "l_discount < 0.09"),
    quality.unique("l_orderkey", "l_linenumber"),
)


def median(work: Callable[[], object], runs: int = 3) -> float:
    work()
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        work()
        taken.append(time.perf_counter() - start)
    return statistics.median(taken)


def checks_one_by_one(df: DataFrame) -> None:
    df.count()
    for check in CHECKS:
        if check.unique_columns:
            df.groupBy(*check.unique_columns).count().filter("count > 1").count()
        else:
            df.filter(check.violated()).count()


def parity_one_by_one(legacy: DataFrame, target: DataFrame) -> None:
    for check in ORDER_CHECKS:
        for side in (legacy, target):
            recon.measure(side, [check]).collect()


def write_then_look(spark: SparkSession, df: DataFrame) -> None:
    df.write.mode("overwrite").format("parquet").saveAsTable("plain_copy")
    written = spark.table("plain_copy")
    written.count()
    checks_one_by_one(written)


def write_and_look(spark: SparkSession, df: DataFrame) -> None:
    staged = tables.stage(df, "staged_copy", quality.violation_counts(CHECKS))
    keyed = [c for c in CHECKS if c.unique_columns]
    quality.results_of(staged.metrics, CHECKS)
    quality.evaluate(spark.table(staged.table), keyed).collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("shapes", cores, cores, **{
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    closed = orders.filter(F.col("o_orderstatus") != "P")
    pairs = {
        "quality, 7 checks": (lambda: checks_one_by_one(lines),
                              lambda: quality.evaluate(lines, CHECKS).collect()),
        "parity, 9 checks": (lambda: parity_one_by_one(orders, closed),
                             lambda: recon.compare(
                                 recon.measure(orders, ORDER_CHECKS),
                                 recon.measure(closed, ORDER_CHECKS), ORDER_CHECKS).collect()),
        "write and check": (lambda: write_then_look(spark, lines),
                            lambda: write_and_look(spark, lines)),
    }
    print(f"{'step':22s} {'one by one':>12s} {'one pass':>12s}")
    for name, (plain, ours) in pairs.items():
        print(f"{name:22s} {median(plain):12.3f} {median(ours):12.3f}")
    spark.stop()


if __name__ == "__main__":
    main()
