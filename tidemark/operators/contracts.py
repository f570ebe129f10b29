"""The declared shape of a table: enforced on write, changed on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A DataFrame does not have the declared shape."""


def contract(ddl: str) -> T.StructType:
    """``"id STRING NOT NULL, amount DECIMAL(18,2)"`` as a schema."""
    return T.StructType.fromDDL(ddl)


def problems(df: DataFrame, schema: T.StructType) -> list[str]:
    """Every difference in columns and types, not just the first."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    found = [f"missing column {name}" for name in want if name not in have]
    found += [f"unexpected column {name}" for name in have if name not in want]
    found += [
        f"column {name} is {have[name].simpleString()}, declared {want[name].simpleString()}"
        for name in want if name in have and have[name] != want[name]
    ]
    return found


def enforce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by name in contract order; the write fails on a NULL in a NOT NULL column.

    Names and types are checked at once, from the plan. Nullability is checked per
    row while the rows are written, so it costs no pass of its own.
    """
    found = problems(df, schema)
    if found:
        raise ContractError("; ".join(found))
    required = [f.name for f in schema.fields if not f.nullable]
    if required:
        present = F.lit(True)
        for name in required:
            present = present & F.col(name).isNotNull()
        message = F.lit(f"NULL in a NOT NULL column ({', '.join(required)})")
        df = df.filter(F.assert_true(present, message).isNull())
    return df.select(*schema.names)


# -- shape changes ----------------------------------------------------------------


def add_column(df: DataFrame, name: str, dtype: str, backfill: Column | None = None) -> DataFrame:
    """Add a column unless it is there, then fill only its NULLs. Safe to repeat."""
    if name not in df.columns:
        df = df.withColumn(name, F.lit(None).cast(dtype))
    if backfill is None:
        return df
    return df.withColumn(name, F.coalesce(F.col(name), backfill.cast(dtype)))


def lossy_casts(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """How many values a type change would lose or alter."""
    value = F.col(name)
    kept = value.try_cast(dtype)
    lost = value.isNotNull() & kept.isNull()
    altered = kept.isNotNull() & ~kept.cast(df.schema[name].dataType).eqNullSafe(value)
    return df.agg(F.count(value).alias("n_values"), F.count_if(lost).alias("n_lost"),
                  F.count_if(altered).alias("n_altered"))


def retype_column(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """The column in its new type, in place; call ``lossy_casts`` first."""
    return df.withColumn(name, F.col(name).try_cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if new in df.columns:
        return df if old not in df.columns else _clash(old, new)
    return df.withColumnRenamed(old, new)


def _clash(old: str, new: str):
    raise ContractError(f"cannot rename {old} to {new}: both exist")


def widened(stored: T.StructType, incoming: T.StructType) -> list[T.StructField]:
    """Columns an append would add. A changed type is an error, never a silent cast."""
    have = {f.name: f.dataType for f in stored.fields}
    clashes = [
        f"column {f.name} is {f.dataType.simpleString()}, stored {have[f.name].simpleString()}"
        for f in incoming.fields if f.name in have and have[f.name] != f.dataType
    ]
    if clashes:
        raise ContractError("; ".join(clashes))
    return [f for f in incoming.fields if f.name not in have]
