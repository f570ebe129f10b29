"""Dimensions and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import date_key
from tidemark.operators.dedupe import orderable, precedes, require_unique
from tidemark.session import ensure_checkpoint_dir


def number_rows(df: DataFrame, order: str, start: Column | int = 0) -> DataFrame:
    """Add ``_number``: 1, 2, 3 … in ``order``, offset by ``start``, without a global window.

    The keys are range-partitioned and sorted, each row takes its index inside its
    partition, and the per-partition counts become offsets. Range bounds come
    from a sample, so the numbered rows are checkpointed: the offsets and the
    rows must see one and the same partitioning, also after an executor is lost.
    Only as many offsets exist as there are shuffle partitions, which is what
    bounds the broadcast.
    """
    ensure_checkpoint_dir(df.sparkSession)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = (
        df.repartitionByRange(F.col(order))
        .sortWithinPartitions(order)
        .withColumns({"_part": F.spark_partition_id(), "_index": index})
        .checkpoint()
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_count"))
    running = F.sum("_count").over(Window.orderBy("_part")) - F.col("_count")
    offsets = counts.select("_part", running.alias("_offset"))
    base = F.lit(start) if isinstance(start, int) else start
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("_number", base + F.col("_offset") + F.col("_index") + 1)
        .drop("_part", "_index", "_offset")
    )


def mint_keys(existing: DataFrame, incoming: DataFrame, natural: str, key: str) -> DataFrame:
    """Surrogate keys for the natural keys that ``existing`` does not have yet.

    Dense above the highest key so far, in natural-key order. Only the natural-key
    columns are read, and only those of new rows sorted and checkpointed.
    """
    # Copies collapse before the rows move, so a natural key that fills a third of the
    # batch reaches the anti join once.
    new = (
        incoming.select(natural).filter(F.col(natural).isNotNull()).distinct()
        .join(existing.select(natural), natural, "left_anti")
    )
    # One value: the highest key handed out so far.
    highest = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).first()[0]
    return number_rows(new, natural, highest).select(natural, F.col("_number").alias(key))


def assign_keys(existing: DataFrame, incoming: DataFrame, natural: str, key: str) -> DataFrame:
    """Attach the surrogate key to ``incoming``: known natural keys keep theirs for ever,
    new ones are minted."""
    known = existing.select(natural, F.col(key).cast("bigint").alias("_known"))
    minted = mint_keys(existing, incoming, natural, key).withColumnRenamed(key, "_minted")
    return (
        incoming.join(known, natural, "left").join(minted, natural, "left")
        .withColumn(key, F.coalesce("_known", "_minted")).drop("_known", "_minted")
    )


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], compare: Sequence[str],
           as_of: Column, insert_only: Sequence[str] = (), stamp: str = "dw_updated_at",
           checked: bool = False) -> DataFrame:
    """Next snapshot of a type-1 dimension.

    A matched row changes only when a ``compare`` column differs, NULL-safely, and
    then takes every source column except ``insert_only`` ones and a new stamp.
    Unmatched target rows stay. ``checked`` says the source is already unique by
    key; otherwise a NULL or repeated key fails the job, as a MERGE would.
    """
    keys = list(keys)
    source = source if checked else require_unique(source, keys)
    offered = [c for c in source.columns if c not in keys]
    left = target.withColumn("_had", F.lit(True))
    right = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in offered],
                          F.lit(True).alias("_came"))
    joined = left.join(right, keys, "full_outer")

    inserted = F.col("_had").isNull()
    differs = F.lit(False)
    for column in compare:
        differs = differs | ~F.col(column).eqNullSafe(F.col(f"_new_{column}"))
    taken = inserted | (F.col("_came").isNotNull() & differs)

    def next_value(column: str, dtype) -> Column:
        if column in keys:
            return F.col(column)
        if column == stamp:
            return F.when(taken, as_of.cast(dtype)).otherwise(F.col(column)).alias(column)
        if column not in offered:
            return F.col(column)
        when = inserted if column in insert_only else taken
        return F.when(when, F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column)

    return joined.select(*[next_value(f.name, f.dataType) for f in target.schema.fields])


def refresh(target: DataFrame, source: DataFrame, natural: str, key: str,
            compare: Sequence[str], as_of: Column, checked: bool = False) -> DataFrame:
    """Next snapshot of a dimension with surrogate keys.

    Only inserted rows need a key, and known rows bring theirs along in the upsert, so
    the stored keys are never joined in: what is added to the upsert is the few new ones.
    They are minted from the arriving keys as they are, which collapse there anyway; the rows
    are checked for repeats once, on their way into the upsert.
    """
    minted = mint_keys(target, source, natural, key)
    source = source if checked else require_unique(source, [natural])
    keyed = source.join(minted, natural, "left")
    return upsert(target, keyed, [natural], compare, as_of, insert_only=[key], checked=True)


def upsert_latest(target: DataFrame, changes: DataFrame, keys: Sequence[str],
                  order_by: str, then_latest: Sequence[str] | None = None) -> DataFrame:
    """Next snapshot of a latest-wins table. ``changes`` holds one row per key.

    A change replaces the stored row unless the stored one is newer, so replaying
    an old batch alters nothing. Between equal order values the change wins, unless
    ``then_latest`` is given: then the order is that of ``dedupe_latest`` over the target's
    columns, and folding slices in any order gives the rows of one dedupe over all. Full outer join rather than a re-dedupe of the
    union: a target bucketed by key is then read in place, and only changes move.
    """
    keys = list(keys)
    rest = [c for c in target.columns if c not in keys]
    left = target.withColumn("_had", F.lit(True))
    right = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest],
                           F.lit(True).alias("_came"))
    if then_latest is None:
        newer = F.coalesce(F.col(f"_new_{order_by}") >= F.col(order_by), F.col(order_by).isNull())
    else:
        latest = [order_by, *then_latest]
        others = [c for c in rest if c not in latest and orderable(target.schema[c].dataType)]
        newer = precedes([*latest, *others], latest, "_new_", "")
    taken = F.col("_came").isNotNull() & (F.col("_had").isNull() | newer)
    joined = left.join(right, keys, "full_outer")
    return joined.select(*[
        F.col(c) if c in keys
        else F.when(taken, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        for c in target.columns
    ])


def build_fact(curated: DataFrame, dim: DataFrame, natural: str, key: str, ts: str) -> DataFrame:
    """Curated rows with their dimension key and integer date key.

    A row whose dimension row has not arrived stays, with a NULL key. Rows
    without a natural key are not facts. The dimension is unique by key, so a
    hot key only ever repeats on the fact side, where the join may split it.
    """
    rows = curated.filter(F.col(natural).isNotNull())
    return (
        rows.join(dim.select(natural, key), natural, "left")
        .withColumn("date_key", date_key(F.col(ts)))
    )


def orphans(fact: DataFrame, dim: DataFrame, natural: str) -> DataFrame:
    """Fact rows with no dimension row."""
    return fact.join(dim.select(natural), natural, "left_anti")


def daily_totals(fact: DataFrame, amount: str, by: Sequence[str] = ("date_key",)) -> DataFrame:
    """Additive mart: exact decimal totals per day."""
    total = F.sum(F.col(amount).cast("decimal(18,2)")).cast("decimal(38,2)")
    return fact.groupBy(*by).agg(total.alias("revenue"), F.count(F.lit(1)).alias("n_rows"))
