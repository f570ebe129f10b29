"""Compare a query with its SQL in DuckDB: columns, types and every value."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Spark type -> the DuckDB type that holds the same values.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = dict(zip(names, [str(d[1]) for d in result.description]))
    expected = _rows(names, result.fetchall())
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        wanted = TYPES.get(kind, kind.upper())
        if kinds[name].replace(" ", "") != wanted.replace(" ", ""):
            found.append(f"{name}: {kind} against {kinds[name]}")
    actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    if actual != expected:
        extra, lacking = actual - expected, expected - actual
        found.append(f"{sum(extra.values())} extra, {sum(lacking.values())} lacking of "
                     f"{sum(expected.values())}; extra {list(extra)[:3]}; "
                     f"lacking {list(lacking)[:3]}")
    if not expected:
        found.append("the query is empty on this data")
    return found
