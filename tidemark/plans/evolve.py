"""Change the shape of a stored table, each change once."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sync
from tidemark.plans import audit, tables
from tidemark.plans.context import RunContext

# Fixed value: how a change is named, V<number>__<description>.
NAME = re.compile(r"^V(\d+)__([a-z0-9_]+)$")


# What a view notes of a change that its table has gone through.
APPLIED = "applied."


class ChangeError(ValueError):
    """A list of changes that must not be applied."""


@dataclass(frozen=True)
class Change:
    """One step from rows to rows. ``checksum`` changes whenever the step does."""

    filename: str
    checksum: str
    step: Callable[[DataFrame], DataFrame]

    @property
    def version(self) -> int:
        match = NAME.match(self.filename)
        if not match:
            raise ChangeError(f"{self.filename}: expected V<number>__<description>")
        return int(match.group(1))


def migrate(spark: SparkSession, ctx: RunContext, table: str,
            changes: Sequence[Change], **layout) -> list[str]:
    """Apply what is pending, in order of version, and return its names.

    All pending steps are one rewrite of the table, not one each. They are noted on the view
    in the very change that shows the new table, so a crash applies nothing twice; the
    evidence follows, in the next run at the latest. A change edited after it was applied is
    refused. ``layout`` is the table's bucketing, which the rewrite has to keep.
    """
    ordered = sorted(changes, key=lambda change: change.version)
    versions = [change.version for change in ordered]
    if len(set(versions)) < len(versions):
        raise ChangeError("two changes share a version")
    ddl = "filename STRING, checksum STRING"
    available = spark.createDataFrame([(c.filename, c.checksum) for c in ordered], ddl)
    name = ctx.ops_table("schema_migration")
    if spark.catalog.tableExists(name):
        applied = spark.table(name).filter((F.col("use_case") == ctx.use_case)
                                           & (F.col("env") == ctx.env)
                                           & (F.col("target_table") == table))
    else:
        applied = spark.createDataFrame([], ddl)
    # One row per change of this table.
    logged = {row.filename: row.checksum for row in applied.select("filename", "checksum").collect()}
    shown = {key.removeprefix(APPLIED): value for key, value in tables.notes(spark, table).items()
             if key.startswith(APPLIED)}
    applied = spark.createDataFrame(list({**logged, **shown}.items()), ddl)
    states = {row.filename: row.state for row in sync.ledger(available, applied).collect()}
    drifted = sorted(n for n, state in states.items() if state == "drifted")
    if drifted:
        raise ChangeError(f"edited after they were applied: {drifted}")
    pending = [change for change in ordered if states[change.filename] == "pending"]
    unlogged = [c for c in ordered if c.filename in shown and c.filename not in logged]
    if pending or unlogged:
        with audit.audited(spark, ctx, "curated"):
            if pending:
                tables.publish(reduce(lambda df, c: c.step(df), pending, spark.table(table)), table,
                               noted={f"{APPLIED}{c.filename}": c.checksum for c in pending}, **layout)
            now = ctx.clock()
            audit.record(spark, ctx, "schema_migration", [
                {"target_table": table, "version": c.version, "name": NAME.match(c.filename)[2],
                 "filename": c.filename, "checksum": c.checksum, "applied_at": now}
                for c in (*unlogged, *pending)])
    return [change.filename for change in pending]
