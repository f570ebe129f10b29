"""A latest-wins table kept by day, of which a fold rewrites only the days that it touches.

A fold touches the days of the rows that arrive, and the days on which an index of keys says that the same keys lie now: a
row whose event time moves leaves the one day and enters the other. Those days are read, merged with what arrives,
written beside the present ones and checked; one commit record then says which days the new files stand for. Until it is
there readers see the old days, all of them; after it the new ones. A fold that is run again, or that failed
half way, changes nothing. Every other day's files are neither read nor written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedupe import dedupe_latest
from tidemark.operators.dims import upsert_latest
from tidemark.operators.quality import DataQualityError, Expectation

DAY, FOLD, SEQ = "_day", "_fold", "_seq"
RECORDS = f"{SEQ} BIGINT, days ARRAY<STRING>, rows BIGINT, {FOLD} STRING"
NO_DAY = "none"


@dataclass(frozen=True)
class Folded:
    """What one fold wrote: the days it stands for, and all rows of theirs."""

    days: list[str]
    rows: int


@dataclass(frozen=True)
class DailyTable:
    """``path`` is a folder that every executor can reach. Keys are not NULL; ``at`` is the event time."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    at: str

    @property
    def _fields(self) -> T.StructType:
        return T._parse_datatype_string(self.schema)

    def _day(self) -> Column:
        return F.coalesce(F.date_format(self.at, "yyyy-MM-dd"), F.lit(NO_DAY))

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def commits(self) -> DataFrame:
        """One row per fold that readers see."""
        return self._read("commits", T._parse_datatype_string(RECORDS))

    def owners(self) -> dict[str, str]:
        """The fold that each day's rows are of. One row per day is collected."""
        return dict(self.commits().select(F.explode("days").alias("day"), SEQ, FOLD).groupBy("day").agg(
            F.max_by(FOLD, SEQ)).collect())

    def rows(self, days: Sequence[str] | None = None) -> DataFrame:
        """The table, or some days of it; conditions are on partitions only, so no other file is opened."""
        owners = self.owners()
        wanted = [f"{day}/{fold}" for day, fold in owners.items() if days is None or day in days]
        stored = T.StructType([*self._fields, T.StructField(DAY, T.StringType()), T.StructField(FOLD, T.StringType())])
        rows = self._read("rows", stored)
        return rows.where(F.concat_ws("/", DAY, FOLD).isin(wanted)).select(*self._fields.names)

    def _key_fields(self) -> T.StructType:
        return T.StructType([f for f in self._fields if f.name in self.keys])

    def _index(self, arriving: DataFrame) -> DataFrame:
        """(keys, day) of those arriving keys that the table holds: the last word of all committed folds."""
        done = [row[0] for row in self.commits().select(FOLD).collect()]  # a row per fold
        schema = T.StructType([*self._key_fields(), T.StructField(DAY, T.StringType()),
                               T.StructField(SEQ, T.LongType()), T.StructField(FOLD, T.StringType())])
        known = self._read("index", schema).where(F.col(FOLD).isin(done))
        keys = list(self.keys)
        return known.join(arriving.select(*keys), keys, "left_semi").groupBy(*keys).agg(
            F.max_by(DAY, SEQ).alias(DAY))

    def fold(self, changes: DataFrame, checks: Sequence[Expectation] = ()) -> Folded:
        """Merge ``changes`` in, the latest row of each key by ``at`` winning, ties as in one dedupe over all.

        ``checks`` run on the days that are written, while they are written; a breach leaves the table as it was.
        """
        keys, name = list(self.keys), uuid.uuid4().hex
        staged = f"{self.path}/staged/{name}"
        dedupe_latest(changes.select(*self._fields.names), keys, self.at).write.parquet(staged)
        arriving = self.spark.read.schema(self._fields).parquet(staged)
        lying = self._index(arriving)
        days = sorted(row[0] for row in arriving.select(self._day().alias(DAY)).unionAll(
            lying.select(DAY)).distinct().collect())  # a row per touched day
        if not days:
            return Folded([], 0)
        merged = upsert_latest(self.rows(days), arriving, keys, self.at, then_latest=())
        seen = Observation()
        counted = merged.observe(seen, F.count(F.lit(1)).alias("rows"), *[
            F.count_if(c.violated()).alias(c.name) for c in checks])
        counted.withColumns({DAY: self._day(), FOLD: F.lit(name)}).hint("rebalance", DAY).write.mode(
            "append").partitionBy(DAY, FOLD).parquet(f"{self.path}/rows")
        counts = seen.get
        broken = {c.name: counts[c.name] for c in checks if counts[c.name] and c.severity == "error"}
        if broken:
            raise DataQualityError(f"{self.path}: {broken} in the days {days[0]} to {days[-1]}")
        number = (self.commits().agg(F.max(SEQ)).first()[0] or 0) + 1
        stored = T.StructType([*self._fields, T.StructField(DAY, T.StringType()), T.StructField(FOLD, T.StringType())])
        fresh = self._read("rows", stored).where(F.concat_ws("/", DAY, FOLD).isin([f"{d}/{name}" for d in days]))
        moved = fresh.join(arriving.select(*keys), keys, "left_semi").select(*keys, DAY, F.lit(number).cast("long").alias(SEQ))
        moved.withColumn(FOLD, F.lit(name)).write.mode("append").partitionBy(FOLD).parquet(f"{self.path}/index")
        record = self.spark.createDataFrame([(number, days, counts["rows"], name)], T._parse_datatype_string(RECORDS))
        record.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return Folded(days, counts["rows"])

    def sweep(self) -> int:
        """Remove the files of days that later folds stand for, and of folds that never ended, once no reader needs them."""
        jvm, owners = self.spark._jvm, self.owners()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        files, dropped = root.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/{DAY}=*/{FOLD}=*")) or []:
            path = status.getPath()
            day, fold = (part.getName().split("=", 1)[1] for part in (path.getParent(), path))
            if owners.get(day) != fold:
                files.delete(path, True)
                dropped += 1
        return dropped
