"""What the operators share: reading tables, cutting lineage, naming rows, counting words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared one that the session names."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and lost executors lose nothing."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Remove what ``written`` wrote, once everything that reads it has been written itself."""
    for stored in tables:
        path = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
        path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: Column, *parts: Column) -> Column:
    """A 64-bit name for a row's content; rows that repeat id and content share it."""
    return F.xxhash64(doc_id, *parts, *[part.isNull() for part in parts])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def repacked(rows: DataFrame, row: str, **replaced: Column) -> DataFrame:
    """The fields of a packed row as columns again, some of them replaced."""
    names = rows.schema[row].dataType.fieldNames()
    return rows.select(*[
        (replaced[name] if name in replaced else F.col(f"{row}.`{name}`")).alias(name)
        for name in names])
