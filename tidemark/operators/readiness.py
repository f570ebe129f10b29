"""From parity runs to the decision whether a use case may cut over."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import before
from tidemark.operators.recon import SKIPPED

GROUP = ("use_case", "env")

def run_grain(targets: DataFrame) -> DataFrame:
    """Target rows to one row per run: clean only when every target passed."""
    return targets.groupBy(*GROUP, "recon_run_id", "started_at").agg(
        F.bool_and(F.coalesce("overall_passed", F.lit(False))).alias("run_clean"),
        F.bool_or(F.col("status") == SKIPPED).alias("run_skipped"),
        F.count(F.lit(1)).alias("targets_checked"),
        F.count_if(F.col("status") == SKIPPED).alias("targets_skipped"),
    )


def readiness(targets: DataFrame) -> DataFrame:
    """Totals and the state of the last run, per use case and environment."""
    last = F.max(F.struct("started_at", "recon_run_id", "run_clean", "run_skipped",
                          "targets_checked"))
    return (
        run_grain(targets).groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("total_runs"),
             F.count_if("run_clean").alias("clean_runs"),
             F.count_if("run_skipped").alias("skipped_runs"),
             last.alias("_last"))
        .select(*GROUP, "total_runs", "clean_runs", "skipped_runs",
                F.col("_last.started_at").alias("last_run_at"),
                F.col("_last.run_clean").alias("last_run_clean"),
                F.col("_last.run_skipped").alias("last_run_skipped"),
                F.col("_last.targets_checked").alias("targets_in_last_run"))
    )


def _streaks(runs: DataFrame, *extra: Column) -> DataFrame:
    position = F.struct("started_at", "recon_run_id")
    broken = (
        runs.groupBy(*GROUP)
        .agg(F.max(F.when(~F.col("run_clean"), position)).alias("_broken"))
    )
    # Salted: one use case may hold a third of all runs. Its single row is repeated per
    # salt, its runs are spread over them, and the counts are added up at the end. There are as
    # many salts as shuffle partitions, so a hot use case can use the whole cluster.
    salts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = broken.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = runs.withColumn("_salt", F.pmod(F.xxhash64("recon_run_id", "started_at"),
                                             F.lit(salts)).cast("int"))
    after = F.col("_broken").isNull() | (position > F.col("_broken"))
    return (
        spread.join(salted, [*GROUP, "_salt"])
        .groupBy(*GROUP)
        .agg(F.count_if(F.col("run_clean") & after).alias("clean_streak"), *extra)
    )


def clean_streak(targets: DataFrame) -> DataFrame:
    """Clean runs in a row up to the latest one; 0 when the latest is not clean.

    Counted as the clean runs after the last unclean one: two plain aggregates
    instead of a sorted window, so a use case with most of the runs is counted in
    parts on every task.
    """
    return _streaks(run_grain(targets))


def coverage(targets: DataFrame, as_of: str | datetime, days: int = 30) -> DataFrame:
    """Run rows and skips per use case in the window; absent means not checked at all."""
    return (
        targets.filter(F.col("started_at") >= before(as_of, days=days))
        .groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("runs"),
             F.count_if(F.col("status") == SKIPPED).alias("skipped"),
             F.max("started_at").alias("last_run"))
    )


def latest_skipped(targets: DataFrame, limit: int = 10) -> DataFrame:
    """The newest skipped run rows with the reason."""
    return (
        targets.filter(F.col("status") == SKIPPED)
        .orderBy(F.col("started_at").desc(), "recon_run_id", "target_name")
        .limit(limit)
    )


def failures(results: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """Failed checks of the last days, newest first."""
    recent = F.col("evaluated_at") >= before(as_of, days=days)
    return results.filter(~F.col("passed") & recent).orderBy(F.col("evaluated_at").desc())


def cutover_gate(targets: DataFrame, quality: DataFrame, needed: int, as_of: str | datetime,
                 days: int = 30) -> DataFrame:
    """Whether each use case may cut over.

    Cleared when the last ``needed`` runs are all clean, no run in the window was
    skipped, and no ``error`` expectation of the use case was breached in it.
    """
    start = before(as_of, days=days)
    skips = F.sum(F.when(F.col("started_at") >= start, F.col("targets_skipped")).otherwise(0))
    breaches = (
        quality.filter(~F.col("passed") & (F.col("severity") == "error")
                       & (F.col("evaluated_at") >= start))
        .groupBy("use_case", "env").agg(F.count(F.lit(1)).alias("breaches_in_window"))
    )
    cleared = ((F.col("clean_streak") >= needed) & (F.col("skipped_in_window") == 0)
               & (F.col("breaches_in_window") == 0))
    return (
        _streaks(run_grain(targets), skips.alias("skipped_in_window"))
        .join(breaches, list(GROUP), "left")
        .fillna(0, ["breaches_in_window"])
        .withColumn("cleared", cleared)
    )


def recent(table: DataFrame, ts: str, as_of: str | datetime, days: int,
           where: Column | None = None) -> DataFrame:
    """Rows of the last days, newest first."""
    chosen = F.col(ts) >= before(as_of, days=days)
    if where is not None:
        chosen = chosen & where
    return table.filter(chosen).orderBy(F.col(ts).desc())
