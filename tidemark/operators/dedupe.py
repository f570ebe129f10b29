"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNORDERED = (T.MapType, T.VariantType)


def orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(orderable(field.dataType) for field in dtype.fields)
    return not isinstance(dtype, _UNORDERED)


def dedupe_latest(df: DataFrame, keys: Sequence[str], order_by: str,
                  tie_break: Sequence[str] | None = None, ascending: bool = False,
                  then_latest: Sequence[str] = ()) -> DataFrame:
    """Keep the latest (or earliest) row per key.

    NULLs sort last either way. Equal order values are decided by ``then_latest``, the
    latest first, and then by ``tie_break`` columns, ascending; by default every other
    orderable column is one, so two rows that still tie are the same row and the result
    never depends on partitioning.

    ``row_number() == 1`` is pruned per map task before the exchange, so a key
    that holds a third of the table ships one row per task, not its whole group.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("dedupe_latest needs at least one key column")
    if tie_break is None:
        tie_break = [f.name for f in df.schema.fields
                     if f.name not in (*keys, order_by, *then_latest) and orderable(f.dataType)]
    first = F.col(order_by).asc_nulls_last() if ascending else F.col(order_by).desc_nulls_last()
    window = Window.partitionBy(*keys).orderBy(
        first, *[F.col(c).desc_nulls_last() for c in then_latest],
        *[F.col(c).asc_nulls_last() for c in tie_break])
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def precedes(names: Sequence[str], latest: Sequence[str], one: str, other: str) -> Column:
    """Whether row ``one`` comes before row ``other`` in the order of ``dedupe_latest``.

    ``one`` and ``other`` are prefixes of the columns; ``latest`` are those of which the higher
    value comes first. NULLs come last, and equal rows do not precede each other.
    """
    before = F.lit(False)
    for name in reversed(list(names)):
        a, b = F.col(f"{one}{name}"), F.col(f"{other}{name}")
        ahead = a > b if name in latest else a < b
        before = F.when(a.eqNullSafe(b), before).otherwise(
            b.isNull() | F.coalesce(ahead, F.lit(False)))
    return before


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "source") -> DataFrame:
    """The same rows, failing the job when a key is NULL or held more than once.

    The aggregation leaves the rows hash-partitioned and sorted by key, which is
    what the join after it needs: the check costs no exchange of its own.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
    grouped = df.groupBy(*keys).agg(F.first(packed).alias("_row"),
                                    F.count(F.lit(1)).alias("_copies"))
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    message = F.concat(F.lit(f"{what}: key is NULL or repeated: "), shown)
    sound = (F.col("_copies") == 1)
    for key in keys:
        sound = sound & F.col(key).isNotNull()
    checked = grouped.filter(F.assert_true(sound, message).isNull())
    return checked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c)
                            for c in df.columns])
