"""Operational reports over the audit, load and log tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import truncate
from tidemark.functions.times import before, days_between, span_seconds
from tidemark.operators.dedupe import dedupe_latest

# Audit statuses, and the name pattern of a personal schema,
# <owner>_<use case or operational scope>.
SUCCESS, RUN_FAILED = "SUCCESS", "FAILED"
OWNED_SCHEMA = "^(.*)_(us[0-9]+|audit|config|logs|recon)$"
MESSAGE_LENGTH, DETAIL_LENGTH = 1000, 8000


def freshness(audit: DataFrame, use_case: str, env: str, tasks: Sequence[str], hours: int,
              as_of: str | datetime) -> DataFrame:
    """One row: did any of these tasks succeed within the window, and when last."""
    chosen = audit.filter(
        (F.col("use_case") == use_case) & (F.col("env") == env)
        & (F.col("status") == SUCCESS) & F.col("task_key").isin(list(tasks))
        & (F.col("ended_at") >= before(as_of, hours=hours))
    )
    last = F.col("last_success")
    return chosen.agg(F.max("ended_at").alias("last_success")).select(
        "last_success", last.isNotNull().alias("proceed"),
        F.when(last.isNotNull(), "PROCEED").otherwise("SKIP").alias("decision"),
    )


def freshness_by_use_case(audit: DataFrame, tasks: Sequence[str], hours: int,
                          as_of: str | datetime) -> DataFrame:
    """The same decision for every use case in the log, in one pass."""
    met = ((F.col("status") == SUCCESS) & F.col("task_key").isin(list(tasks))
           & (F.col("ended_at") >= before(as_of, hours=hours)))
    last = F.col("last_success")
    return (
        audit.groupBy("use_case", "env")
        .agg(F.max(F.when(met, F.col("ended_at"))).alias("last_success"))
        .withColumns({"proceed": last.isNotNull(),
                      "decision": F.when(last.isNotNull(), "PROCEED").otherwise("SKIP")})
    )


def latest_attempt(audit: DataFrame) -> DataFrame:
    """The newest row per run and task, with its duration and shortened messages."""
    newest = dedupe_latest(audit, ["run_id", "task_key"], "started_at")
    seconds = F.round(span_seconds(F.col("started_at"), F.col("ended_at")), 3)
    return newest.withColumns({
        "duration_seconds": seconds.cast("double"),
        "error_message": truncate(F.col("error_message"), MESSAGE_LENGTH),
    })


def latest_load(loads: DataFrame, since: Column | None = None) -> DataFrame:
    """Rows added by the most recent load of each table."""
    if since is not None:
        loads = loads.filter(F.col("loaded_at") >= since)
    last = F.max(F.struct("loaded_at", "run_id", "source_id", "rows_written"))
    return loads.groupBy("target_table").agg(last.alias("_last")).select(
        "target_table", "_last.loaded_at", "_last.run_id", "_last.source_id",
        F.coalesce(F.col("_last.rows_written"), F.lit(0)).alias("rows_written"))


def reported_rows(metrics: Column, name: str = "numOutputRows") -> Column:
    """A row count out of a text map of metrics; NULL when absent or not a number."""
    return F.try_element_at(metrics, F.lit(name)).try_cast("bigint")


def load_summary(loads: DataFrame) -> DataFrame:
    """Per landing run: tables, rows and failures. Runs also after a partial failure."""
    failed = F.col("status") == RUN_FAILED
    return loads.groupBy("run_id", "use_case").agg(
        F.count(F.lit(1)).alias("n_loads"),
        F.coalesce(F.sum("rows_written"), F.lit(0)).alias("total_rows"),
        F.count_if(failed).alias("failed_loads"),
        F.max("loaded_at").alias("last_loaded_at"),
    )


def retained(log: DataFrame, ts: str, days: int, as_of: str | datetime) -> DataFrame:
    """Rows young enough to keep."""
    return log.filter(F.col(ts) >= before(as_of, days=days))


def schema_inventory(tables: DataFrame, as_of: str | datetime,
                     catalog_like: str = "%!_nonprod") -> DataFrame:
    """Personal schemas with their owner, scope, size and idle days.

    ``tables`` has one row per table: catalog, schema and last change.
    """
    name = F.col("table_schema")
    owned = (F.like(F.col("table_catalog"), F.lit(catalog_like), F.lit("!"))
             & name.rlike(OWNED_SCHEMA.replace("(.*)", ".+")))
    return (
        tables.filter(owned)
        .groupBy("table_catalog", "table_schema")
        .agg(F.count(F.lit(1)).alias("table_count"), F.max("last_altered").alias("last_touched"))
        .withColumns({
            "owner_prefix": F.regexp_extract(name, OWNED_SCHEMA, 1),
            "scope": F.regexp_extract(name, OWNED_SCHEMA, 2),
            "days_idle": days_between(F.col("last_touched"), as_of),
        })
    )


def stale_schemas(inventory: DataFrame, days: int = 30) -> DataFrame:
    """Schemas idle for long, most idle first, with a label for whoever decides."""
    label = F.concat(F.lit("review "), "table_catalog", F.lit("."), "table_schema")
    return (
        inventory.filter(F.col("days_idle") >= days)
        .withColumn("review_action", label)
        .orderBy(F.col("days_idle").desc(), "table_catalog", "table_schema")
    )


def footprint(inventory: DataFrame) -> DataFrame:
    """Schemas and tables per owner, and how long ago the last activity was."""
    full_name = F.concat("table_catalog", F.lit("."), "table_schema")
    return inventory.groupBy("owner_prefix").agg(
        F.count_distinct(full_name).alias("schemas"),
        F.sum("table_count").alias("tables"),
        F.min("days_idle").alias("days_since_last_activity"),
    ).orderBy(F.col("schemas").desc(), "owner_prefix")
