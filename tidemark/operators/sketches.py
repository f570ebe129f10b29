"""Distinct counts that add up: a sketch a day, kept as state, merged without reading any day again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_CONFIG = 14


def error(lg_config: int = LG_CONFIG) -> float:
    """Relative standard error of an estimate: 0.8 % at the default, whatever the count."""
    return 1.04 / 2 ** (lg_config / 2)


def daily(df: DataFrame, day: str, columns: Sequence[str], lg_config: int = LG_CONFIG) -> DataFrame:
    """(day, rows, one sketch per column): a few KB a day and column. NULL is not counted."""
    return df.groupBy(day).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(c, lg_config).alias(c) for c in columns])


def extended(state: DataFrame, df: DataFrame, day: str, columns: Sequence[str],
             lg_config: int = LG_CONFIG) -> DataFrame:
    """The state with the days it does not have. Days are partitions, a row each here, so those that are there
    are ruled out before their files are opened."""
    known = [row[0] for row in state.select(day).collect()]
    return state.unionByName(daily(df.where(~F.col(day).isin(known)) if known else df, day, columns, lg_config))


def estimates(state: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Distinct counts over all days of the state, or per ``by``, from the sketches alone."""
    return state.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
