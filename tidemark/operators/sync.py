"""Keep a stored table in step with a declared one, and high-water marks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.maps import comparable
from tidemark.functions.times import ntz
from tidemark.operators.dedupe import require_unique

INSERT, UPDATE, DEACTIVATE, UNCHANGED = "insert", "update", "deactivate", "unchanged"
# Rows the sync leaves alone: switched off earlier, or owned by another scope.
RETIRED, OUT_OF_SCOPE = "retired", "out_of_scope"


def _matched(desired: DataFrame, existing: DataFrame, key: str, columns: Sequence[str],
             active: str, scope: str | None, deactivate_missing: bool) -> DataFrame:
    """Both sides by key, with ``_action``; desired values are prefixed ``_want_``."""
    in_scope = F.coalesce(F.expr(scope), F.lit(False)) if scope else F.lit(True)
    wanted = require_unique(desired.filter(in_scope).select(key, *columns), [key], "desired")
    want = wanted.select(key, *[F.col(c).alias(f"_want_{c}") for c in columns],
                         F.lit(True).alias("_wanted"))
    have = existing.withColumns({"_stored": F.lit(True), "_in_scope": in_scope})
    types = {f.name: f.dataType for f in existing.schema.fields}

    differs = F.lit(False)
    for c in columns:
        stored = comparable(F.col(c), types[c])
        differs = differs | ~stored.eqNullSafe(comparable(F.col(f"_want_{c}"), types[c]))
    leaves = F.col(active) & F.lit(deactivate_missing)
    action = (
        F.when(F.col("_stored").isNull(), INSERT)
        .when(~F.col("_in_scope") & F.col("_wanted").isNull(), OUT_OF_SCOPE)
        .when(F.col("_wanted").isNotNull() & differs, UPDATE)
        .when(F.col("_wanted").isNotNull(), UNCHANGED)
        .when(leaves, DEACTIVATE)
        .otherwise(F.when(F.col(active), UNCHANGED).otherwise(RETIRED))
    )
    return have.join(want, key, "full_outer").withColumn("_action", action)


def plan(desired: DataFrame, existing: DataFrame, key: str, columns: Sequence[str],
         active: str = "is_active", scope: str | None = None,
         deactivate_missing: bool = True) -> DataFrame:
    """What a sync would do: one row per key with its action.

    ``scope`` (SQL text over a column both sides have) limits the sync to one
    subset, so that rows of other subsets do not look missing.
    """
    matched = _matched(desired, existing, key, columns, active, scope, deactivate_missing)
    return matched.select(key, F.col("_action").alias("action"))


def summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n_rows"))


def apply(desired: DataFrame, existing: DataFrame, key: str, columns: Sequence[str],
          as_of: Column, active: str = "is_active", created: str = "created_at",
          updated: str = "updated_at", scope: str | None = None,
          deactivate_missing: bool = True) -> DataFrame:
    """The stored table after the sync. Rows are switched off, never removed.

    Only rows that really change get a new ``updated`` time.
    """
    matched = _matched(desired, existing, key, columns, active, scope, deactivate_missing)
    action = F.col("_action")
    taken = action.isin(INSERT, UPDATE)

    def next_value(name: str, dtype) -> Column:
        now = as_of.cast(dtype)
        if name == key:
            return F.col(key)
        if name == created:
            return F.when(action == INSERT, now).otherwise(F.col(name)).alias(name)
        if name == updated:
            moved = action.isin(INSERT, UPDATE, DEACTIVATE)
            return F.when(moved, now).otherwise(F.col(name)).alias(name)
        offered = F.col(f"_want_{name}") if name in columns else F.lit(None)
        if name == active:
            fresh = offered if name in columns else F.lit(True)
            return (F.when(action == DEACTIVATE, F.lit(False)).when(taken, fresh)
                    .otherwise(F.col(name)).alias(name))
        if name not in columns:
            return F.col(name)
        return F.when(taken, offered).otherwise(F.col(name)).alias(name)

    return matched.select(*[next_value(f.name, f.dataType) for f in existing.schema.fields])


# -- high-water marks ---------------------------------------------------------

MARKS_DDL = ("source_id STRING, ts_value TIMESTAMP_NTZ, long_value BIGINT, "
             "exact_value DECIMAL(38,10), real_value DOUBLE, updated_at TIMESTAMP_NTZ")
_VALUES = ("ts_value", "long_value", "exact_value", "real_value")
DECIMALS = 10
Mark = datetime | int | Decimal | float


def mark_column(dtype: T.DataType, column: str) -> str:
    """Which of the typed values a mark over a column of this type is.

    Dates are kept as their midnight, whole and floating numbers as they are, decimals exactly, up to
    ten places: a rounded mark would pass over rows. Text has no order that a source is sure to share, so it is refused.
    """
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "ts_value"
    if isinstance(dtype, T.IntegralType):
        return "long_value"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "real_value"
    if isinstance(dtype, T.DecimalType) and dtype.scale <= DECIMALS:
        return "exact_value"
    raise ValueError(f"{column}: a {dtype.simpleString()} column cannot carry a mark")


def mark_value(column: str, dtype: T.DataType) -> Column:
    """Highest value of a column, as the mark of its kind."""
    kinds = dict(zip(_VALUES, ("timestamp_ntz", "bigint", "decimal(38,10)", "double")))
    kind = mark_column(dtype, column)
    return _highest_finite(column) if kind == "real_value" else F.max(column).cast(kinds[kind])


def _highest_finite(column: str) -> Column:
    """Nothing comes after infinity or what is not a number, so neither is ever a mark."""
    value = F.col(column).cast("double")
    return F.max(F.when(F.abs(value) < float("inf"), value))


def batch_marks(df: DataFrame, source_id: str | Column, ts: str | None = None,
                number: str | None = None, exact: str | None = None,
                real: str | None = None) -> DataFrame:
    """Highest value of this batch per source, typed."""
    source = F.lit(source_id) if isinstance(source_id, str) else source_id
    ts_value = F.max(ts) if ts else F.lit(None)
    long_value = F.max(number) if number else F.lit(None)
    exact_value = F.max(exact) if exact else F.lit(None)
    return df.groupBy(source.alias("source_id")).agg(
        ts_value.cast("timestamp_ntz").alias("ts_value"),
        long_value.cast("bigint").alias("long_value"),
        exact_value.cast("decimal(38,10)").alias("exact_value"),
        (_highest_finite(real) if real else F.lit(None).cast("double")).alias("real_value"),
    )


def advance(marks: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Marks after a committed batch: forward or unchanged, never back.

    Values are compared as timestamps and numbers, so 10 is above 9 and a missing
    fraction of a second makes no difference.
    """
    new = batch.select("source_id", *[F.col(c).alias(f"_new_{c}") for c in _VALUES])
    moved = F.lit(False)
    for c in _VALUES:
        moved = moved | F.coalesce(F.col(f"_new_{c}") > F.col(c), F.col(c).isNull()
                                   & F.col(f"_new_{c}").isNotNull())
    joined = marks.join(new, "source_id", "full_outer")
    return joined.select(
        "source_id",
        *[F.greatest(F.col(c), F.col(f"_new_{c}")).alias(c) for c in _VALUES],
        F.when(moved, as_of.cast("timestamp_ntz")).otherwise(F.col("updated_at"))
        .alias("updated_at"),
    )


def reset(marks: DataFrame, source_id: str, value: Mark, as_of: Column) -> DataFrame:
    """Set one mark back on purpose, to reload from a point."""
    chosen = F.col("source_id") == source_id
    stamp = F.when(chosen, as_of.cast("timestamp_ntz")).otherwise(F.col("updated_at"))
    if isinstance(value, datetime):
        name, new = "ts_value", ntz(value)
    elif isinstance(value, Decimal):
        name, new = "exact_value", F.lit(value).cast("decimal(38,10)")
    elif isinstance(value, float):
        name, new = "real_value", F.lit(value)
    else:
        name, new = "long_value", F.lit(int(value)).cast("bigint")
    return marks.withColumns({name: F.when(chosen, new).otherwise(F.col(name)),
                              "updated_at": stamp})


def read_marks(marks: DataFrame, source_ids: Sequence[str]) -> dict[str, Mark]:
    """The stored marks of the sources that have one, in one read."""
    wanted = marks.filter(F.col("source_id").isin(list(source_ids)))
    found = {row.source_id: [row[name] for name in _VALUES if row[name] is not None]
             for row in wanted.select("source_id", *_VALUES).collect()}
    return {source_id: values[0] for source_id, values in found.items() if values}


def read_mark(marks: DataFrame, source_id: str) -> Mark | None:
    """The stored mark of one source; None before its first load."""
    return read_marks(marks, [source_id]).get(source_id)


# -- applied-once ledger --------------------------------------------------------


def ledger(available: DataFrame, applied: DataFrame, name: str = "filename",
           checksum: str = "checksum") -> DataFrame:
    """State of every available change: pending, applied, or drifted since.

    One left join serves both questions. Names and checksums are all that moves.
    """
    done = require_unique(applied.select(name, F.col(checksum).alias("_recorded")),
                          [name], "applied")
    state = (
        F.when(F.col("_recorded").isNull(), "pending")
        .when(F.col("_recorded") != F.col(checksum), "drifted")
        .otherwise("applied")
    )
    listed = available.select(name, checksum)
    return listed.join(done, name, "left").select(name, checksum, state.alias("state"))
