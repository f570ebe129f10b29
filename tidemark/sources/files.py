"""Extracts that arrive as files, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("json", "csv", "parquet", "orc", "text")
CORRUPT = "_corrupt"


def _options(fmt: str, schema: T.StructType, options: dict[str, str]) -> tuple:
    if fmt not in FORMATS:
        raise ValueError(f"file format is one of {FORMATS}")
    if fmt in ("json", "csv"):
        # Records that do not fit the schema are kept whole, in a column of their own.
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    if fmt == "csv":
        options = {"header": "true", "enforceSchema": "false", **options}
    return schema, options


def read_files(spark: SparkSession, path: str | list[str], fmt: str, ddl: str,
               **options: str) -> DataFrame:
    """Files with a declared schema; nothing is inferred, so nothing is read twice."""
    schema, options = _options(fmt, T.StructType.fromDDL(ddl), options)
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def stream_files(spark: SparkSession, path: str, fmt: str, ddl: str,
                 max_files: int = 1000, **options: str) -> DataFrame:
    """New files in a folder as a stream, a bounded number per micro-batch."""
    schema, options = _options(fmt, T.StructType.fromDDL(ddl), options)
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files).options(**options).load(path))


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files whose schemas grew over time, columns united by name.

    Reads every footer. A landing table appended through the catalog does not need
    it: its schema grows at write time.
    """
    return spark.read.option("mergeSchema", "true").parquet(path)


def united(*parts: DataFrame) -> DataFrame:
    """DataFrames of different shapes as one; a column a part lacks is NULL there."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The first ``rows`` rows by key: a repeatable slice for development only."""
    return df.orderBy(key).limit(rows)
