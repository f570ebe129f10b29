"""Turn landed records into curated rows: parse, conform, report the unknown."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import blank_to_null, known_code, normalise_code

CORRUPT = "_corrupt"
MISSING = "_missing"


def parse_payload(df: DataFrame, ddl: str, payload: str = "payload", mode: str = "PERMISSIVE",
                  required: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Parse JSON text against a declared schema.

    Two things a parser alone does not tell apart are reported per row:
    ``_corrupt`` holds the text of a record that is not valid for the schema, and
    ``_missing`` lists required fields the record does not carry. A renamed
    upstream field would otherwise read as NULL without a trace. ``mode`` may be
    FAILFAST to stop on the first bad record, missing fields included.
    """
    fields = T.StructType.fromDDL(ddl).fields
    names = [field.name for field in fields]
    expected = list(names if required is None else required)
    lenient = mode.upper() == "PERMISSIVE"
    options = {"mode": mode.upper()}
    schema = T.StructType(list(fields))
    if lenient:
        schema = schema.add(CORRUPT, T.StringType())
        options["columnNameOfCorruptRecord"] = CORRUPT

    # Unnested through a generator, each record is parsed exactly once: a later
    # filter on a parsed column cannot be pushed below it and parse again.
    record = F.array(F.from_json(F.col("_text"), schema, options))
    parsed = (
        df.select(*keep, F.col(payload).alias("_text"))
        .select(*keep, "_text", F.inline(record))
    )
    # Only rows in which a required field came out NULL are read a second time,
    # for the names they really carry.
    no_names = F.array().cast("array<string>")
    present = F.coalesce(F.json_object_keys("_text"), no_names)
    absent = F.array_except(F.array(*[F.lit(name) for name in expected]).cast("array<string>"),
                            present)
    suspect = F.lit(False)
    for name in expected:
        suspect = suspect | F.col(name).isNull()
    missing = F.when(suspect & (F.size(absent) > 0), absent)
    if lenient:
        # Empty and NULL payloads never reach the parser, so they are marked here.
        unread = F.when(blank_to_null(F.col("_text")).isNull(), F.coalesce("_text", F.lit("")))
        corrupt = F.coalesce(F.col(CORRUPT), unread)
        return parsed.select(*keep, *names, corrupt.alias(CORRUPT),
                             F.when(corrupt.isNull(), missing).alias(MISSING))
    message = F.concat(F.lit("record lacks required fields: "), F.array_join(missing, ", "))
    checked = parsed.filter(F.assert_true(missing.isNull(), message).isNull())
    return checked.select(*keep, *names, F.lit(None).cast("string").alias(CORRUPT),
                          F.lit(None).cast("array<string>").alias(MISSING))


@dataclass(frozen=True)
class Field:
    """One column of a curated contract and how it is obtained.

    ``allowed`` makes it a code column: values outside the set become NULL and
    the row is kept. ``code`` normalises case and padding only. ``default``
    replaces an absent value. Text that names a zone or offset is read as that
    instant, whether the column keeps a zone or not.
    """

    name: str
    source: str | None = None
    type: str = "string"
    code: bool = False
    allowed: tuple[str, ...] = ()
    default: Any = None

    def column(self, stored: T.DataType) -> Column:
        value = F.col(self.source or self.name)
        if self.allowed:
            value = known_code(value.cast("string"), self.allowed)
        elif self.code:
            value = normalise_code(value.cast("string"))
        if self.type == "timestamp_ntz" and isinstance(stored, T.StringType):
            # A direct cast would drop the offset and keep the digits.
            value = value.try_cast("timestamp").cast("timestamp_ntz")
        elif self.type != "string":
            value = value.try_cast(self.type)
        elif not (self.allowed or self.code):
            value = value.cast("string")
        if self.default is not None:
            value = F.coalesce(value, F.lit(self.default).cast(self.type))
        return value.alias(self.name)


def conform(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Project landed rows onto the contract. Narrow; never drops a row."""
    stored = df.select(*[F.col(field.source or field.name) for field in fields]).schema.fields
    return df.select(*[field.column(column.dataType) for field, column in zip(fields, stored)])


def unknown_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Raw codes that are present but not recognised, and how often each occurs."""
    raw = F.col(column)
    unrecognised = blank_to_null(raw).isNotNull() & known_code(raw, tuple(allowed)).isNull()
    return (
        df.filter(unrecognised)
        .groupBy(raw.alias("raw_value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
