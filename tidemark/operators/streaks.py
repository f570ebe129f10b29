"""Clean streaks that add up: a state a log day, merged in order, so readiness reads only the days that are new.

The state of a stretch of the log is how many runs it has, and how many of them are clean before its first and after its
last unclean one. Two states that follow one another merge into the state of both, however the log is cut.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.readiness import GROUP, run_grain

_STATE = ("runs", "prefix", "suffix")


def by_day(targets: DataFrame) -> DataFrame:
    """(use case, environment, day, runs, prefix, suffix). A run belongs to the day it started on.

    Two plain aggregates and a join on the day's one row of breaks: nothing is sorted, and a use case with most of a
    day's runs may be split.
    """
    keys = (*GROUP, "day")
    runs = run_grain(targets).withColumn("day", F.to_date("started_at"))
    position = F.struct("started_at", "recon_run_id")
    breaks = runs.where(~F.col("run_clean")).groupBy(*keys).agg(
        F.min(position).alias("_first"), F.max(position).alias("_last"))
    unbroken = F.col("_first").isNull()
    return runs.join(breaks, list(keys), "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(unbroken | (position < F.col("_first"))).alias("prefix"),
        F.count_if(unbroken | (position > F.col("_last"))).alias("suffix"))


def extended(state: DataFrame, targets: DataFrame, since: date) -> DataFrame:
    """The state with the days from ``since`` on counted (anew); earlier days are neither read nor changed."""
    new = targets.where(F.col("started_at") >= F.lit(since).cast("timestamp_ntz"))
    return state.where(F.col("day") < F.lit(since)).unionByName(by_day(new))


def _then(earlier: Column, later: Column) -> Column:
    runs = earlier["runs"] + later["runs"]
    reach = lambda own, whole, other: F.when(own == whole, whole + other).otherwise(own)
    return F.struct(later["day"].alias("day"), runs.alias("runs"),
                    reach(earlier["prefix"], earlier["runs"], later["prefix"]).alias("prefix"),
                    reach(later["suffix"], later["runs"], earlier["suffix"]).alias("suffix"))


def merged(state: DataFrame, period: Column | None = None) -> DataFrame:
    """States of one period each (a month, say), or of all days, under their last day; they merge again.

    A use case has a row a day, so what one group gathers is bounded by the calendar.
    """
    none = F.struct(F.lit(None).cast("date").alias("day"), *[F.lit(0).cast("long").alias(name) for name in _STATE])
    days = F.array_sort(F.collect_list(F.struct("day", *_STATE)))
    by = [F.col(name) for name in GROUP] + ([] if period is None else [period.alias("_period")])
    return state.groupBy(*by).agg(F.aggregate(days, none, _then).alias("_all")).select(*GROUP, "_all.*")


def clean_streak(state: DataFrame) -> DataFrame:
    """Runs so far and the clean ones up to the latest, from the states alone."""
    return merged(state).select(*GROUP, "runs", F.col("suffix").alias("clean_streak"))
