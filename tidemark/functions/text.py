"""Text normalisation, key lists and column naming."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD_EDGE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_SEPARATORS = re.compile(r"[^0-9A-Za-z]+")


def blank_to_null(value: Column) -> Column:
    """Trimmed text, with the empty string read as absent."""
    return F.nullif(F.trim(value), F.lit(""))


def normalise_code(value: Column) -> Column:
    """Trimmed, upper-cased code; blank is absent."""
    return F.upper(blank_to_null(value))


def known_code(value: Column, allowed: list[str] | tuple[str, ...]) -> Column:
    """The normalised code when it is a known one, otherwise NULL."""
    code = normalise_code(value)
    return F.when(code.isin(list(allowed)), code)


def split_keys(csv: Column) -> Column:
    """``"a, b,,c "`` -> ``["a", "b", "c"]``; NULL stays NULL."""
    parts = F.transform(F.split(csv, ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def join_keys(keys: Column) -> Column:
    """Back to comma-separated text; an empty list becomes NULL."""
    return F.when(F.size(keys) > 0, F.array_join(keys, ","))


def snake_case(name: str) -> str:
    """``OrderID`` / ``Order-Id`` / ``ORDER ID`` -> ``order_id``.

    The leading underscore of a framework column stays.
    """
    words = _SEPARATORS.sub("_", _WORD_EDGE.sub("_", name.strip()))
    return ("_" if name.startswith("_") else "") + words.strip("_").lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; two names that collide are an error."""
    names = [snake_case(name) for name in df.columns]
    clashes = sorted({name for name in names if names.count(name) > 1 or not name})
    if clashes:
        raise ValueError(f"columns collide after renaming: {clashes}")
    return df.toDF(*names)


def truncate(value: Column, length: int) -> Column:
    return F.substring(value, 1, length)
