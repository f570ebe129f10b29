"""Surrogate keys kept in sorted runs of files, of which an assignment reads the row groups that may hold its keys.

A run is sorted by natural key and its row groups carry bounds and Bloom filters of it. A batch of at most ``MOST`` different
keys names them in the filter of the scan, ten at a time, which is what the reader tests against both; a larger one is
joined. Only keys that no run holds are written, as a run of their own, above the highest key of all records. A run
counts once its record is there, so an assignment that failed, or runs again, hands out each key once. ``merge``
makes one run of all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dims import number_rows

RUN = "_run"
RECORDS = f"{RUN} STRING, highest BIGINT, rows BIGINT, replaces ARRAY<STRING>"
MOST = 1000  # keys that a scan is told by name
TOLD = 10  # values of one condition; the reader sees only the bounds of longer lists


@dataclass(frozen=True)
class KeyMap:
    """``path`` is a folder that every executor can reach; ``natural`` is named with its type, as in ``id BIGINT``."""

    spark: SparkSession
    path: str
    natural: str
    key: str
    group_bytes: int = 16 << 20

    @property
    def _fields(self) -> T.StructType:
        return T._parse_datatype_string(f"{self.natural}, {self.key} BIGINT")

    @property
    def _name(self) -> str:
        return self._fields[0].name

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def records(self) -> DataFrame:
        """One row per run that was completed."""
        return self._read("records", T._parse_datatype_string(RECORDS))

    def _runs(self) -> tuple[list[str], int]:
        """The runs that stand, and the highest key handed out. A row per run is collected."""
        found = self.records().collect()
        gone = {name for row in found for name in row["replaces"]}
        return [row[RUN] for row in found if row[RUN] not in gone], max([0, *[row["highest"] for row in found]])

    def rows(self) -> DataFrame:
        """(natural, key) of all runs that stand."""
        stored = T.StructType([*self._fields, T.StructField(RUN, T.StringType())])
        return self._read("runs", stored).where(F.col(RUN).isin(self._runs()[0])).select(*self._fields.names)

    def holding(self, keys: DataFrame) -> DataFrame:
        """The rows of those natural keys; ``keys`` is a stored table of different ones."""
        name = self._name
        named = [row[0] for row in keys.select(name).limit(MOST + 1).collect()]
        if len(named) > MOST:
            return self.rows().join(keys.select(name), name, "left_semi")
        if not named:
            return self.rows().where(F.lit(False))
        named.sort()
        return self.rows().where(reduce(or_, [
            F.col(name).isin(named[i:i + TOLD]) for i in range(0, len(named), TOLD)]))

    def _write(self, rows: DataFrame, run: str, highest: int, replaces: list[str]) -> None:
        name = self._name
        (rows.repartitionByRange(name).sortWithinPartitions(name).write
         .option(f"parquet.bloom.filter.enabled#{name}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
         .option("parquet.block.size", self.group_bytes).mode("overwrite").parquet(f"{self.path}/runs/{RUN}={run}"))
        count = self.spark.read.schema(self._fields).parquet(f"{self.path}/runs/{RUN}={run}").count()
        record = self.spark.createDataFrame([(run, highest + (0 if replaces else count), count, replaces)],
                                            T._parse_datatype_string(RECORDS))
        record.coalesce(1).write.mode("append").parquet(f"{self.path}/records")

    def assign(self, incoming: DataFrame) -> DataFrame:
        """``incoming`` with its surrogate keys; those of a NULL natural key are NULL.

        New keys are dense above the highest, in the order of their natural keys.
        """
        name, run = self._name, uuid.uuid4().hex
        staged = f"{self.path}/staged/{run}"
        incoming.select(F.col(name).cast(self._fields[0].dataType)).where(F.col(name).isNotNull()).distinct().write.parquet(staged)
        keys = self.spark.read.schema(T.StructType([self._fields[0]])).parquet(staged)
        known = self.holding(keys)
        highest = self._runs()[1]
        fresh = number_rows(keys.join(known.select(name), name, "left_anti"), name, highest).select(
            name, F.col("_number").cast("bigint").alias(self.key))
        if not fresh.isEmpty():
            self._write(fresh, run, highest, [])
        return incoming.join(self.holding(keys), name, "left")

    def merge(self) -> int:
        """One sorted run in place of all that stand; returns how many there were. Old files stay for readers under way."""
        runs, highest = self._runs()
        if len(runs) > 1:
            self._write(self.rows(), uuid.uuid4().hex, highest, runs)
        return len(runs)
