"""Append-only evidence: task runs, table loads, quality results, application log."""

from __future__ import annotations

import traceback
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import replace
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.reports import DETAIL_LENGTH, MESSAGE_LENGTH, RUN_FAILED, SUCCESS
from tidemark.plans.context import RunContext
from tidemark.plans.tables import append, ensure_database

# Every table is declared: a row whose error columns are all NULL has no types to infer.
SCHEMAS = {
    "job_run": (
        "run_id STRING, job_id STRING, task_key STRING, use_case STRING, layer STRING, "
        "status STRING, started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ, "
        "duration_seconds DOUBLE, error_message STRING, error_detail STRING, "
        "context_tags MAP<STRING, STRING>"),
    "table_load": (
        "run_id STRING, use_case STRING, source_id STRING, target_table STRING, "
        "load_strategy STRING, rows_written BIGINT, watermark_from STRING, "
        "watermark_to STRING, status STRING, loaded_at TIMESTAMP_NTZ"),
    "data_quality_result": (
        "run_id STRING, use_case STRING, table_name STRING, expectation_name STRING, "
        "expectation_predicate STRING, severity STRING, rows_evaluated BIGINT, "
        "rows_failed BIGINT, passed BOOLEAN, evaluated_at TIMESTAMP_NTZ"),
    "application_log": (
        "run_id STRING, use_case STRING, layer STRING, task_key STRING, level STRING, "
        "logger STRING, message STRING, context MAP<STRING, STRING>, "
        "logged_at TIMESTAMP_NTZ"),
    "schema_migration": (
        "use_case STRING, target_table STRING, version INT, name STRING, filename STRING, "
        "checksum STRING, applied_at TIMESTAMP_NTZ, run_id STRING"),
    "parity_run": (
        "recon_run_id STRING, use_case STRING, target_name STRING, layer STRING, "
        "target_table STRING, source_ref STRING, status STRING, checks_total INT, "
        "checks_passed INT, checks_failed INT, overall_passed BOOLEAN, "
        "started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ, notes STRING"),
    "parity_check_result": (
        "recon_run_id STRING, use_case STRING, target_name STRING, check_name STRING, "
        "check_type STRING, column_name STRING, legacy_metric DECIMAL(38,6), "
        "target_metric DECIMAL(38,6), difference DECIMAL(38,6), relative_diff DOUBLE, "
        "tolerance DOUBLE, justification STRING, passed BOOLEAN, "
        "evaluated_at TIMESTAMP_NTZ"),
    "parity_exception": (
        "recon_run_id STRING, use_case STRING, target_name STRING, check_name STRING, "
        "key_values MAP<STRING, STRING>, legacy_value STRING, target_value STRING, "
        "captured_at TIMESTAMP_NTZ"),
}
# Logs are partitioned by environment and day: windows prune, and old days drop whole.
# The ledger of shape changes is read in full, always.
_BY_DAY, _BY_ENV = ("env", "log_date"), ("env",)


def partitions_of(table: str) -> tuple[str, ...]:
    return _BY_ENV if table == "schema_migration" else _BY_DAY


def schema_of(table: str) -> T.StructType:
    keys = ", ".join(f"{key} STRING" for key in partitions_of(table))
    return T.StructType.fromDDL(f"{SCHEMAS[table]}, {keys}")


def bootstrap(spark: SparkSession, ctx: RunContext) -> None:
    """Create the logs of a use case that do not exist yet."""
    for table in SCHEMAS:
        name = ctx.ops_table(table)
        ensure_database(spark, name)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                            for f in schema_of(table).fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                  f"PARTITIONED BY ({', '.join(partitions_of(table))})")


def evidence(spark: SparkSession, ctx: RunContext, table: str,
             use_cases: Sequence[str], since: datetime | None = None) -> DataFrame:
    """One log of several use cases as one DataFrame; a use case without it adds no rows.

    ``since`` skips the days before it, in this environment's partitions only.
    """
    names = [replace(ctx, use_case=use_case).ops_table(table) for use_case in use_cases]
    logs = [spark.table(name) for name in names if spark.catalog.tableExists(name)]
    none = spark.createDataFrame([], schema_of(table))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs, none)
    if since is not None:
        rows = rows.filter((F.col("env") == ctx.env) & (F.col("log_date") >= f"{since:%Y-%m-%d}"))
    return rows


def record(spark: SparkSession, ctx: RunContext, table: str,
           rows: Sequence[Mapping[str, Any]]) -> None:
    """Append rows with bound values to an evidence table."""
    if not rows:
        return
    schema = schema_of(table)
    shared = {"run_id": ctx.run_id, "recon_run_id": ctx.run_id, "use_case": ctx.use_case,
              "env": ctx.env, "log_date": f"{ctx.clock():%Y-%m-%d}"}
    values = [tuple({**shared, **row}.get(name) for name in schema.names) for row in rows]
    df = spark.createDataFrame(values, schema).coalesce(1)
    append(df, ctx.ops_table(table), partitions_of(table))


def load_row(ctx: RunContext, source_id: str, target_table: str, rows_written: int,
             load_strategy: str, watermark_from: Any = None, watermark_to: Any = None,
             status: str = SUCCESS) -> dict[str, Any]:
    def text(mark: Any) -> str | None:
        if mark is None:
            return None
        return mark.isoformat() if isinstance(mark, datetime) else str(mark)

    return {"source_id": source_id, "target_table": target_table,
            "load_strategy": load_strategy, "rows_written": rows_written,
            "watermark_from": text(watermark_from), "watermark_to": text(watermark_to),
            "status": status, "loaded_at": ctx.clock()}


def record_loads(spark: SparkSession, ctx: RunContext, rows: Sequence[dict[str, Any]]) -> None:
    """Append the loads of one step in one write."""
    record(spark, ctx, "table_load", rows)


def record_quality(spark: SparkSession, ctx: RunContext, table_name: str,
                   results: Sequence[Mapping[str, Any]]) -> None:
    now = ctx.clock()
    record(spark, ctx, "data_quality_result",
           [{**r, "table_name": table_name, "evaluated_at": now} for r in results])


def log(spark: SparkSession, ctx: RunContext, layer: str,
        entries: Sequence[tuple[str, str, str, dict[str, str]]]) -> None:
    """Append (level, logger, message, context) entries, by day so that days can expire."""
    now = ctx.clock()
    record(spark, ctx, "application_log", [
        {"layer": layer, "task_key": ctx.task_key, "level": level, "logger": logger,
         "message": message, "context": context, "logged_at": now}
        for level, logger, message, context in entries])


@contextmanager
def audited(spark: SparkSession, ctx: RunContext, layer: str) -> Iterator[None]:
    """Exactly one terminal row per task, whatever happens; the error goes on up.

    Gates belong inside: a task whose data did not pass is not a success that a
    later gate may rely on.
    """
    started = ctx.clock()

    def close(status: str, error: BaseException | None = None) -> None:
        ended = ctx.clock()
        record(spark, ctx, "job_run", [{
            "job_id": ctx.job_id, "task_key": ctx.task_key, "layer": layer, "status": status,
            "started_at": started, "ended_at": ended,
            "duration_seconds": round((ended - started).total_seconds(), 3),
            "error_message": f"{type(error).__name__}: {error}"[:MESSAGE_LENGTH]
            if error else None,
            "error_detail": "".join(traceback.format_exception(error))[:DETAIL_LENGTH]
            if error else None,
            "context_tags": dict(ctx.tags)}])

    try:
        yield
    except BaseException as error:
        try:
            close(RUN_FAILED, error)
        except Exception as lost:  # the task's own error matters more
            error.add_note(f"the audit row could not be written: {lost}")
        raise
    close(SUCCESS)
