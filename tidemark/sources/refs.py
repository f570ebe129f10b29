"""Open a table, view or extract by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import FORMATS


def open_ref(spark: SparkSession, ref: str,
             openers: Mapping[str, Callable[[str], DataFrame]] | None = None) -> DataFrame:
    """``schema.table`` from the catalog, ``parquet:/path`` from files, or
    ``<scheme>:<name>`` through an opener, such as a database read."""
    scheme, separator, rest = ref.partition(":")
    if not separator:
        return spark.table(ref)
    if openers and scheme in openers:
        return openers[scheme](rest)
    if scheme in FORMATS:
        return spark.read.format(scheme).load(rest)
    raise ValueError(f"nothing opens {ref!r}")
