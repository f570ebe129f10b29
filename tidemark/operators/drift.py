"""What payloads really carry, day by day, against what is declared.

Every payload is read as it is, without a schema, and reduced to its shape: the names of its fields and the kinds of
their values. Shapes are counted on the map side, so what moves is one row per day and different shape, not per record;
only then are fields compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDED, GONE, RETYPED, UNREADABLE = "added", "gone", "retyped", "unreadable"

# Kinds of JSON values that a declared type reads without loss; NULL fits every type.
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE")
_KINDS: dict[type, tuple[str, ...]] = {
    T.StringType: ("STRING",), T.BooleanType: ("BOOLEAN",), T.StructType: ("OBJECT",), T.MapType: ("OBJECT",),
    T.ArrayType: ("ARRAY",), T.DateType: ("STRING",), T.TimestampType: ("STRING",), T.TimestampNTZType: ("STRING",),
    T.ByteType: ("BIGINT",), T.ShortType: ("BIGINT",), T.IntegerType: ("BIGINT",), T.LongType: ("BIGINT",),
    T.FloatType: _NUMBERS, T.DoubleType: _NUMBERS, T.DecimalType: _NUMBERS}
_ANY = ("ARRAY", "BOOLEAN", "OBJECT", "STRING", *_NUMBERS)
_FINDING = "array<struct<field: string, change: string, found: string>>"


def shape(payload: str) -> Column:
    """(field, kind) of every field, by name; NULL where the text is no JSON object. What lies inside objects
    and arrays is not looked at."""
    fields = F.try_parse_json(payload).try_cast("map<string, variant>")
    kind = lambda value: F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(
        e["key"].alias("field"), F.when(F.is_variant_null(e["value"]), "VOID").otherwise(kind(e["value"])).alias("kind"))))


def shapes(df: DataFrame, day: str, payload: str = "payload") -> DataFrame:
    """(day, shape, n_rows): what is kept of a day; days add up without being read again."""
    return df.groupBy(F.col(day).alias("day"), shape(payload).alias("shape")).agg(F.count(F.lit(1)).alias("n_rows"))


def drift(counted: DataFrame, ddl: str) -> DataFrame:
    """One row per field and change, with the days that first and last show it and the records that do.

    ``gone`` counts records without a declared field, ``added`` those with another one, ``retyped`` those whose value
    the declared type cannot hold (``found`` is its kind), ``unreadable`` those that are no JSON object.
    """
    declared = T.StructType.fromDDL(ddl).fields
    names = F.array(*[F.lit(f.name) for f in declared]).cast("array<string>")
    kinds = F.create_map(*[part for f in declared for part in (
        F.lit(f.name), F.array(*[F.lit(k) for k in ("VOID", *_KINDS.get(type(f.dataType), _ANY))]))])
    here = F.transform("shape", lambda e: e["field"])
    finding = lambda field, change, found: F.struct(
        field.alias("field"), F.lit(change).alias("change"), found.alias("found"))
    nothing = F.lit(None).cast("string")
    strangers = F.filter("shape", lambda e: ~F.array_contains(names, e["field"]))
    misfits = F.filter("shape", lambda e: F.array_contains(names, e["field"])
                       & ~F.array_contains(F.try_element_at(kinds, e["field"]), e["kind"]))
    found = F.when(F.col("shape").isNull(), F.array(finding(nothing, UNREADABLE, nothing)).cast(_FINDING)).otherwise(
        F.concat(F.transform(F.array_except(names, here), lambda n: finding(n, GONE, nothing)).cast(_FINDING),
                 F.transform(strangers, lambda e: finding(e["field"], ADDED, e["kind"])).cast(_FINDING),
                 F.transform(misfits, lambda e: finding(e["field"], RETYPED, e["kind"])).cast(_FINDING)))
    return counted.select("day", "n_rows", F.inline(found)).groupBy("field", "change", "found").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n_rows").alias("n_rows"))
