"""Land a source: data first, then its mark, then the evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import ntz
from tidemark.operators import sync
from tidemark.operators.lineage import stamp
from tidemark.plans import audit, tables
from tidemark.plans.context import RunContext
from tidemark.sources.registry import SourceSpec
from tidemark.streaming.landing import Drained

Reader = Callable[[SourceSpec, sync.Mark | None], DataFrame]


@dataclass(frozen=True)
class Landed:
    source_id: str
    rows: int
    mark: sync.Mark | None
    error: str | None = None


def _marks_table(ctx: RunContext) -> str:
    return ctx.ops_table("landing_watermark")


def _marks(spark: SparkSession, ctx: RunContext) -> DataFrame:
    name = _marks_table(ctx)
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], sync.MARKS_DDL)
    stored = spark.table(name)
    if "real_value" not in stored.columns:  # written before marks could be floating
        stored = stored.withColumn("real_value", F.lit(None).cast("double"))
    return stored


def current_mark(spark: SparkSession, ctx: RunContext, spec: SourceSpec) -> sync.Mark | None:
    return sync.read_mark(_marks(spark, ctx), spec.source_id)


def _store_marks(spark: SparkSession, ctx: RunContext,
                 reached: dict[str, sync.Mark]) -> None:
    """Move the marks of the sources that landed rows, in one write."""
    rows = [(source_id, mark if isinstance(mark, datetime) else None,
             mark if isinstance(mark, int) else None,
             mark if isinstance(mark, Decimal) else None,
             mark if isinstance(mark, float) else None, None)
            for source_id, mark in reached.items()]
    moved = sync.advance(_marks(spark, ctx), spark.createDataFrame(rows, sync.MARKS_DDL),
                         ntz(ctx.clock()))
    tables.publish(moved.coalesce(1), _marks_table(ctx))


def reset_mark(spark: SparkSession, ctx: RunContext, source_id: str,
               mark: sync.Mark) -> None:
    """Set a mark back, so that the next run reloads from there."""
    moved = sync.reset(_marks(spark, ctx), source_id, mark, ntz(ctx.clock()))
    tables.publish(moved.coalesce(1), _marks_table(ctx))


def _write(ctx: RunContext, df: DataFrame, spec: SourceSpec, table: str) -> tuple:
    """Write one batch; its row count and highest mark, as seen by the write itself.

    Nothing is read back: a second read of the source could see other rows.
    """
    as_of = ctx.clock()
    incremental = spec.load_strategy == "incremental"
    # The kind of mark is settled before anything is written: a batch that landed without
    # moving its mark would land again in every run.
    high = (sync.mark_value(spec.watermark_column, df.select(spec.watermark_column).schema[0].dataType)
            if incremental else F.lit(None))
    rows = stamp(df, spec.source_id, ctx.run_id, ntz(as_of)) \
        .withColumn("_load_date", F.lit(f"{as_of:%Y-%m-%d}"))
    if spec.load_strategy == "full":
        return tables.publish(rows, table).rows, None
    seen = Observation()
    marked = [high.alias("mark")] if incremental else []
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n_written"), *marked)
    tables.append(counted, table, partition_by=["_load_date"])
    return int(seen.get["n_written"]), seen.get["mark"] if incremental else None


def _close(spark: SparkSession, ctx: RunContext, written: Sequence[tuple]) -> list[Landed]:
    """Move the marks, then write the evidence: a crash in between loads a batch twice,
    which curation removes, and never skips one."""
    reached = {spec.source_id: high for spec, _, _, _, high, _ in written if high is not None}
    if reached:
        _store_marks(spark, ctx, reached)
    landed, rows_of_log = [], []
    for spec, table, known, rows, high, error in written:
        mark = known if high is None else high
        landed.append(Landed(spec.source_id, rows, mark, error))
        rows_of_log.append(audit.load_row(
            ctx, spec.source_id, table, rows, spec.load_strategy, known, mark,
            audit.RUN_FAILED if error else audit.SUCCESS))
    audit.record_loads(spark, ctx, rows_of_log)
    return landed


def land(spark: SparkSession, ctx: RunContext, spec: SourceSpec, table: str,
         read: Reader) -> Landed:
    """One batch source end to end: data, mark, evidence."""
    known = current_mark(spark, ctx, spec)
    rows, high = _write(ctx, read(spec, known), spec, table)
    return _close(spark, ctx, [(spec, table, known, rows, high, None)])[0]


def land_all(spark: SparkSession, ctx: RunContext, specs: Sequence[SourceSpec],
             table_of: Callable[[SourceSpec], str], read: Reader,
             at_once: int = 4) -> list[Landed]:
    """Several sources side by side, a bounded number at a time.

    One failing source does not stop the others. Marks and evidence share tables, so
    they are written one after the other once the data is down.
    """
    known = sync.read_marks(_marks(spark, ctx), [spec.source_id for spec in specs])

    def write(spec: SourceSpec) -> tuple:
        start, table = known.get(spec.source_id), table_of(spec)
        try:
            return spec, table, start, *_write(ctx, read(spec, start), spec, table), None
        except Exception as error:
            return spec, table, start, 0, None, f"{type(error).__name__}: {error}"

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        written = list(pool.map(write, specs))
    return _close(spark, ctx, written)


def copy_layer(spark: SparkSession, ctx: RunContext, source: str, target: str) -> int:
    """A straight full copy of one table to the next layer; returns its rows."""
    done = tables.publish(spark.table(source), target)
    audit.record_loads(spark, ctx, [audit.load_row(ctx, source, target, done.rows, "full")])
    return done.rows


class LandingIncomplete(RuntimeError):
    """Some sources of a run did not land."""


def summarise(spark: SparkSession, ctx: RunContext) -> int:
    """Rows landed by this run; an error that names the sources that failed and did not
    land in a later attempt.

    Runs after the loads whatever became of them: a partial failure is when the
    summary matters.
    """
    loads = spark.table(ctx.ops_table("table_load")).filter(
        (F.col("env") == ctx.env) & (F.col("run_id") == ctx.run_id)
        & (F.col("use_case") == ctx.use_case))
    # One row per source of one run.
    last = loads.groupBy("source_id").agg(
        F.max_by("status", "loaded_at").alias("status"),
        F.sum("rows_written").alias("n_rows")).orderBy("source_id").collect()
    total = sum(row.n_rows or 0 for row in last)
    failed = [row.source_id for row in last if row.status == audit.RUN_FAILED]
    if failed:
        raise LandingIncomplete(f"{len(failed)} source(s) failed, {total} rows landed: {failed}")
    return total


def record_drained(spark: SparkSession, ctx: RunContext, drained: Sequence[Drained],
                   table_of: Callable[[str], str]) -> None:
    """Copy what the streams counted to the load log, so that one query answers what landed."""
    audit.record_loads(spark, ctx, [
        audit.load_row(ctx, done.source_id, table_of(done.source_id), done.rows_kept,
                       "cdc_stream", status=audit.RUN_FAILED if done.error else audit.SUCCESS)
        for done in drained])
