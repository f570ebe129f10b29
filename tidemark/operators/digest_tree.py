"""Comparing two large tables by stored digests, descending only into what differs.

Each side keeps one digest a row, partitioned by a bucket of its key; a side can be digested where it lies, and only its digests travel.
Two sides are first compared by sums per bucket, then, in buckets that differ, by sums per branch below it, and rows are read
only of branches that differ. Buckets are partitions of the stored digests, so others are not opened.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digests import NULL_TEXT, canonical_text

BUCKET, BRANCH, DIGEST = "_bucket", "_branch", "_digest"


@dataclass(frozen=True)
class Fan:
    """How many buckets there are, and branches in each; both sides of a comparison need the same."""

    buckets: int = 256
    branches: int = 256


def digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fan: Fan = Fan()) -> DataFrame:
    """The keys, where they fall, and one 64-bit digest of the values, NULL included, however a side stores them."""
    def text(name: str) -> Column:
        return F.coalesce(canonical_text(F.col(name), df.schema[name].dataType), F.lit(NULL_TEXT))

    place = F.xxhash64(*[text(k) for k in keys])
    return df.select(
        *keys, F.xxhash64(*[text(c) for c in columns]).alias(DIGEST),
        F.pmod(F.shiftright(place, 32), F.lit(fan.branches)).cast("int").alias(BRANCH),
        F.pmod(place, F.lit(fan.buckets)).cast("int").alias(BUCKET))


def store(df: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str], fan: Fan = Fan()) -> DataFrame:
    """Write a side's digests, a folder a bucket, and read them. Rows move once, and adaptive execution splits
    a bucket that a repeated key has filled."""
    rows = digests(df, keys, columns, fan)
    rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def sums(rows: DataFrame, *by: str) -> DataFrame:
    """Rows and digests added up per ``by``. A digest is added in three parts, none of which can overflow."""
    digest = F.col(DIGEST)
    low = F.lit((1 << 20) - 1)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.shiftright(digest, 40)).alias("high"),
        F.sum(F.shiftright(digest, 20).bitwiseAND(low)).alias("middle"), F.sum(digest.bitwiseAND(low)).alias("low"))


_SUMS = ("rows", "high", "middle", "low")


def apart(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """The ``by`` whose sums are not the same on both sides, or that only one side has."""
    stacked = sums(left, *by).unionAll(sums(right, *by).select(*by, *[(-F.col(c)).alias(c) for c in _SUMS]))
    total = stacked.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])
    differs = F.lit(False)
    for c in _SUMS:
        differs = differs | (F.col(c) != 0)
    return total.where(differs).select(*by)


@dataclass(frozen=True)
class Found:
    """What differs, and the buckets that had to be opened for it."""

    buckets: list[int]
    rows: DataFrame


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Found:
    """Stored digests of two sides; ``rows`` has (keys, status): only_left, only_right or changed.

    A key that is repeated agrees where both sides hold the same rows of it as often.
    """
    buckets = sorted(row[0] for row in apart(left, right, BUCKET).collect())  # at most as many as the fan has
    opened = [side.where(F.col(BUCKET).isin(buckets)) for side in (left, right)]
    branches = apart(*opened, BUCKET, BRANCH)  # at most buckets times branches, two numbers each
    ours, theirs = (side.join(branches, [BUCKET, BRANCH], "left_semi") for side in opened)
    stacked = ours.select(*keys, DIGEST, F.lit(1).alias("n")).unionAll(theirs.select(*keys, DIGEST, F.lit(-1).alias("n")))
    held = stacked.groupBy(*keys, DIGEST).agg(F.sum("n").alias("n")).where("n <> 0")
    per_key = held.groupBy(*keys).agg(F.max("n").alias("most"), F.min("n").alias("least"))
    status = F.when(F.col("least") > 0, "only_left").when(F.col("most") < 0, "only_right").otherwise("changed")
    return Found(buckets, per_key.select(*keys, status.alias("status")))
