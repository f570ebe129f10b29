"""Where a landed row came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp(df: DataFrame, source_id: str, run_id: str, as_of: Column) -> DataFrame:
    """Add load time, source and run to every landed row."""
    return df.withColumns({"_ingested_at": as_of, "_source_id": F.lit(source_id),
                           "_run_id": F.lit(run_id)})
