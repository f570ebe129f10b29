"""Time expressions. The clock is always a parameter, never ``current_timestamp``."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ntz(value: str | datetime) -> Column:
    """A zone-free timestamp literal; folds to a constant, so filters push down."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def literal_of(value: Any, dtype: T.DataType) -> Column:
    """A literal of the column's own type.

    A plain ``lit(datetime)`` is zone-aware; compared with a zone-free column it
    would put a cast on the column and lose the pushed-down filter.
    """
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(dtype)


def before(as_of: str | datetime, days: int = 0, hours: int = 0) -> Column:
    """``as_of`` minus the given span."""
    return ntz(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))


def date_key(ts: Column) -> Column:
    """``yyyyMMdd`` as INT, in integer arithmetic rather than through text."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def span_seconds(start: Column, end: Column) -> Column:
    """``end - start`` in seconds with microseconds, as DECIMAL(38,6), zone-free."""
    gap = end - start
    whole = (
        F.extract(F.lit("DAY"), gap).cast("decimal(20,0)") * 86400
        + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60
    )
    return (whole + F.extract(F.lit("SECOND"), gap)).cast("decimal(38,6)")


def days_between(earlier: Column, as_of: str | datetime) -> Column:
    return F.datediff(ntz(as_of).cast("date"), earlier.cast("date"))
