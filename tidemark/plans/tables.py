"""Writing tables: a snapshot behind a view, or an append whose schema may grow."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.contracts import widened

OWN = "tidemark."
VERSION, UP_TO = f"{OWN}version", f"{OWN}upto"


@dataclass(frozen=True)
class Staged:
    """A written version that nobody sees yet, with what the write itself counted."""

    name: str
    table: str
    version: int
    rows: int
    metrics: dict[str, Any]


@dataclass(frozen=True)
class Published:
    name: str
    version: int
    rows: int


def ensure_database(spark: SparkSession, name: str) -> None:
    database, dot, _ = name.rpartition(".")
    if dot:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    if not spark.catalog.tableExists(name):
        return {}
    return {row.key: row.value for row in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def version_of(spark: SparkSession, name: str) -> int:
    """Version the view shows now; 0 before the first publication."""
    return int(_properties(spark, name).get(VERSION, 0))


def folded_up_to(spark: SparkSession, name: str) -> int:
    """What the last publisher recorded, such as the last stream batch folded in; -1 if none."""
    return int(_properties(spark, name).get(UP_TO, -1))


def stage(df: DataFrame, name: str, metrics: Sequence[Column] = (),
          bucket_by: Sequence[str] = (), buckets: int = 0, placed: bool = False,
          partition_by: Sequence[str] = ()) -> Staged:
    """Write the next version beside the current one.

    Rows, and any further ``metrics``, are counted while the rows are written, not by a
    pass afterwards. Bucketing by the key lets the next upsert or fact join read this
    side in place. ``placed`` says the rows come out of a dedupe or upsert by that key and
    so lie in ``spark.sql.shuffle.partitions`` hash partitions of it: with as many buckets
    they are written as they lie. Otherwise they move once, so that a bucket is one
    file and not one per task.
    """
    spark = df.sparkSession
    ensure_database(spark, name)
    version = version_of(spark, name) + 1
    table = f"{name}__v{version}"
    # Left behind by a run that failed between writing and publishing.
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    lie = placed and int(spark.conf.get("spark.sql.shuffle.partitions")) == buckets
    if bucket_by and not lie:
        df = df.repartition(buckets, *bucket_by)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n_written"), *metrics)
    writer = counted.write.format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    counts = dict(seen.get)
    return Staged(name, table, version, int(counts.pop("n_written")), counts)


def swap(spark: SparkSession, staged: Staged, up_to: int | None = None,
         keep: int = 2, noted: dict[str, str] | None = None) -> Published:
    """Point the view at the staged version in one catalog change.

    Readers see the old rows or the new ones, never half a table. The last
    ``keep`` versions stay for queries that started before the change. What earlier
    publishers noted on the view is carried over; ``noted`` adds to it in the same change.
    """
    properties = {key: value for key, value in _properties(spark, staged.name).items()
                  if key.startswith(OWN)}
    properties |= {VERSION: str(staged.version), **{f"{OWN}{k}": v for k, v in (noted or {}).items()}}
    if up_to is not None:
        properties[UP_TO] = str(up_to)
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    spark.sql(f"CREATE OR REPLACE VIEW {staged.name} TBLPROPERTIES ({listed}) "
              f"AS SELECT * FROM {staged.table}")
    if staged.version > keep:
        spark.sql(f"DROP TABLE IF EXISTS {staged.name}__v{staged.version - keep}")
    return Published(staged.name, staged.version, staged.rows)


def notes(spark: SparkSession, name: str) -> dict[str, str]:
    """What publishers have noted on the view, by the name they gave it."""
    return {key.removeprefix(OWN): value for key, value in _properties(spark, name).items()
            if key.startswith(OWN)}


def publish(df: DataFrame, name: str, up_to: int | None = None, keep: int = 2,
            noted: dict[str, str] | None = None, **layout: Any) -> Published:
    """Replace a table in full. It may be among the inputs of ``df``: it is not
    touched while being read."""
    return swap(df.sparkSession, stage(df, name, **layout), up_to, keep, noted)


def append(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a landing or log table, adding the columns it does not have yet.

    The schema grows in the catalog, at write time, so readers never have to open
    every footer to find out what columns exist. A changed type is an error.
    """
    spark = df.sparkSession
    ensure_database(spark, name)
    writer = df.write
    if spark.catalog.tableExists(name):
        stored = spark.table(name)
        new = widened(stored.schema, df.schema)
        if new:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
            stored = spark.table(name)
        writer = df.select(*[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in stored.schema.fields
        ]).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.mode("append").format("parquet").saveAsTable(name)


def replace_partitions(df: DataFrame, name: str, *by: str) -> None:
    """Write rows so that the partitions they fall into hold these rows and no others.

    Writing the same rows again changes nothing; other partitions are not touched.
    """
    create_partitioned(df.sparkSession, name, df.schema, *by)
    ordered = [c for c in df.columns if c not in by]
    df.select(*ordered, *by).write.mode("overwrite").insertInto(name)


def create_partitioned(spark: SparkSession, name: str, schema: StructType, *by: str) -> None:
    ensure_database(spark, name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({', '.join(f'`{c}`' for c in by)})")


def drop_partitions(spark: SparkSession, name: str,
                    expired: Callable[[dict[str, str]], bool]) -> int:
    """Drop whole partitions: a catalog change, no data is rewritten.

    What is listed is one row per partition, never the rows in it.
    """
    dropped = []
    for row in spark.sql(f"SHOW PARTITIONS {name}").collect():
        values = dict(part.split("=", 1) for part in row[0].split("/"))
        if expired(values):
            dropped.append(", ".join(f"{k} = '{v}'" for k, v in values.items()))
    if dropped:
        specs = ", ".join(f"PARTITION ({spec})" for spec in dropped)
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {specs}")
    return len(dropped)


def drop_expired_days(spark: SparkSession, name: str, column: str, keep_from: str) -> int:
    """Retention of a log partitioned by day: drop the days before ``keep_from``."""
    return drop_partitions(spark, name, lambda values: values[column] < keep_from)
