"""Bring the stored source registry in step with what is declared."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.times import ntz
from tidemark.operators import sync
from tidemark.operators.contracts import contract, enforce
from tidemark.plans import audit, tables
from tidemark.plans.context import RunContext
from tidemark.sources.registry import DECLARABLE, REGISTRY_DDL

TABLE = "landing_source"
_OWNED = [name for name in DECLARABLE if name != "source_id"]


def stored(spark: SparkSession, ctx: RunContext) -> DataFrame:
    name = ctx.shared_table(TABLE)
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], contract(REGISTRY_DDL))


def seed(spark: SparkSession, ctx: RunContext, rows: Sequence[dict[str, Any]],
         use_case: str | None = None, dry_run: bool = False) -> dict[str, int]:
    """Apply declared rows and return how many of each action it took.

    A source that is no longer declared is switched off, never removed, so its mark and
    history stay. ``use_case`` limits the run to one use case. A dry run, or one
    that finds nothing to change, writes nothing.
    """
    schema = contract(REGISTRY_DDL)
    shape = contract(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields
                               if f.name in DECLARABLE))
    desired = spark.createDataFrame([tuple(r.get(n) for n in shape.names) for r in rows], shape)
    existing = stored(spark, ctx)
    scope = f"use_case = '{use_case}'" if use_case else None
    actions = sync.summary(sync.plan(desired, existing, "source_id", _OWNED, scope=scope))
    # One row per kind of action.
    counts = {row.action: row.n_rows for row in actions.collect()}
    changing = {sync.INSERT, sync.UPDATE, sync.DEACTIVATE} & set(counts)
    if changing and not dry_run:
        with audit.audited(spark, ctx, "landing"):
            after = sync.apply(desired, existing, "source_id", _OWNED, ntz(ctx.clock()),
                               scope=scope)
            tables.publish(enforce(after, schema).coalesce(1), ctx.shared_table(TABLE))
    return counts
