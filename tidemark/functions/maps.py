"""Option maps: text values, empty as absent, comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import blank_to_null


def text_map(value: Column) -> Column:
    """Map values as text; an empty map is NULL."""
    as_text = F.transform_values(value, lambda _, v: v.cast("string"))
    return F.when(F.size(value) > 0, as_text)


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A form in which two stored values compare equal when they mean the same.

    Blank text, empty lists and empty maps all mean "absent"; map order does not
    matter; numbers and booleans compare as they are.
    """
    if isinstance(dtype, T.StringType):
        return blank_to_null(value)
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(text_map(value)))
    if isinstance(dtype, T.ArrayType):
        return F.when(F.size(value) > 0, value)
    return value
