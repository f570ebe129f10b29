"""Order-independent digests of a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text that stands for NULL inside a digest.
NULL_TEXT = "<null>"


def _without_zeros(decimal: Column) -> Column:
    """The text of a number that has decimals, as short as it can be; zero may come as 0E-10."""
    short = F.rtrim(F.rtrim(decimal, F.lit("0")), F.lit("."))
    return F.when(decimal.contains("E"), _plain(decimal)).otherwise(short)


def _plain(decimal: Column) -> Column:
    """Small numbers that come in exponents, digit by digit."""
    digits = F.replace(F.regexp_extract(decimal, r"^-?([0-9.]+)E", 1), F.lit("."), F.lit(""))
    zeros = F.repeat(F.lit("0"), F.regexp_extract(decimal, r"E-(\d+)$", 1).cast("int") - 1)
    sign = F.when(decimal.startswith("-"), "-").otherwise("")
    small = F.rtrim(F.concat(sign, F.lit("0."), zeros, digits), F.lit("0"))
    return F.when(F.regexp_like(decimal, F.lit("^-?0E")), "0").otherwise(small)


def canonical_text(value: Column, dtype: T.DataType) -> Column:
    """Text that does not depend on how either side stores the value.

    Numbers are written without trailing zeros, exact ones in full and floating ones to six
    decimals; a date is its midnight and timestamps are in UTC. So one value kept as BIGINT or
    DECIMAL(38,10), as DOUBLE or DECIMAL, or as DATE or TIMESTAMP agrees with itself, and
    two exact values that differ in any decimal do not.
    """
    if isinstance(dtype, T.DecimalType):
        return _without_zeros(value.cast("string")) if dtype.scale else value.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        exact = value.try_cast("decimal(38,6)")
        # A double outside the decimal range keeps its own text instead of vanishing.
        return F.coalesce(_without_zeros(exact.cast("string")), value.cast("string"))
    if isinstance(dtype, T.DateType):
        return value.cast("timestamp_ntz").cast("string")
    if isinstance(dtype, T.TimestampType):
        return F.to_utc_timestamp(value, F.current_timezone()).cast("timestamp_ntz").cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def crc32_word(text: Column) -> Column:
    return F.crc32(text)


def md5_word(text: Column) -> Column:
    """First 32 bits of the MD5, for engines without CRC-32."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def digest_sum(value: Column, dtype: T.DataType,
               word: Callable[[Column], Column] = crc32_word,
               where: Column | None = None) -> Column:
    """Sum of one 32-bit word per row, NULL included, as DECIMAL(38,0).

    The halves are summed as two BIGINTs: one BIGINT of whole words would
    overflow after about four billion rows, and a wide DECIMAL buffer would
    leave the fast aggregation path.
    """
    bits = word(F.coalesce(canonical_text(value, dtype), F.lit(NULL_TEXT)))
    if where is not None:
        bits = F.when(where, bits)
    high = F.sum(F.shiftright(bits, 16)).cast("decimal(38,0)")
    low = F.sum(bits.bitwiseAND(F.lit(0xFFFF))).cast("decimal(38,0)")
    return F.coalesce((high * 65536 + low).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
