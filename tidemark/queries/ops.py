"""Operational reports: events read as audit, load and inventory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import before, date_key
from tidemark.operators import readiness, recon, reports
from tidemark.queries.catalogue import AS_OF, query, table


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """One task execution per event; short ones failed."""
    failed = F.col("value") < 5
    seconds = F.round("value", 2).cast("decimal(18,6)")
    return table(spark, sf, "events").select(
        date_key(F.col("ts")).cast("string").alias("run_id"), F.col("event_type").alias("task_key"),
        F.concat(F.lit("us"), F.col("user_id").cast("string")).alias("use_case"),
        F.lit("prod").alias("env"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("ended_at"),
        F.when(failed, F.repeat("props", 200)).alias("error_message"))


_AUDIT_SQL = """
WITH audit AS (
  SELECT strftime(ts, '%Y%m%d') AS run_id, event_type AS task_key, 'us' || user_id AS use_case,
         'prod' AS env, CASE WHEN value < 5 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         ts AS started_at,
         ts + to_microseconds(CAST(round(value * 100) AS BIGINT) * 10000) AS ended_at,
         CAST(round(value * 100) AS BIGINT) / 100 AS seconds,
         CASE WHEN value < 5 THEN repeat(props, 200) END AS error_message
  FROM events)
"""


@query(f"""{_AUDIT_SQL}
SELECT use_case, env, last_success, last_success IS NOT NULL AS proceed,
       CASE WHEN last_success IS NOT NULL THEN 'PROCEED' ELSE 'SKIP' END AS decision
FROM (SELECT use_case, env, max(ended_at) FILTER (
               WHERE status = 'SUCCESS' AND task_key IN ('purchase', 'view')
                 AND ended_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS) AS last_success
      FROM audit GROUP BY use_case, env)
""")
def freshness_gate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.freshness_by_use_case(audit_log(spark, sf), ["purchase", "view"], 24, AS_OF)


@query(f"""{_AUDIT_SQL}
SELECT max(ended_at) AS last_success, max(ended_at) IS NOT NULL AS proceed,
       CASE WHEN max(ended_at) IS NOT NULL THEN 'PROCEED' ELSE 'SKIP' END AS decision
FROM audit
WHERE use_case = 'us1' AND env = 'prod' AND status = 'SUCCESS'
  AND task_key IN ('click', 'purchase')
  AND ended_at >= TIMESTAMP '{AS_OF}' - INTERVAL 120 HOURS
""")
def freshness_one(spark: SparkSession, sf: str) -> DataFrame:
    """The gate of a single use case, as a reconciliation asks for it."""
    return reports.freshness(audit_log(spark, sf), "us1", "prod", ["click", "purchase"], 120,
                             AS_OF)


@query(f"""{_AUDIT_SQL},
late AS (SELECT use_case, env FROM audit GROUP BY use_case, env
         HAVING count(*) FILTER (WHERE status = 'SUCCESS' AND task_key IN ('purchase', 'view')
                  AND ended_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS) = 0)
SELECT use_case, env, task_key AS target_name, CAST(count(*) AS INTEGER) AS checks_total,
       0 AS checks_passed, 0 AS checks_failed, FALSE AS overall_passed, 'SKIPPED' AS status
FROM audit JOIN late USING (use_case, env) GROUP BY use_case, env, task_key
""")
def recon_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Run rows of the use cases whose load is late: every target skipped, none clean."""
    log = audit_log(spark, sf)
    decisions = reports.freshness_by_use_case(log, ["purchase", "view"], 24, AS_OF)
    late = decisions.filter(~F.col("proceed")).select("use_case", "env")
    planned = log.withColumnRenamed("task_key", "target_name")
    return recon.skipped(planned.join(late, ["use_case", "env"], "left_semi"),
                         ["use_case", "env", "target_name"])


@query(f"""{_AUDIT_SQL}
SELECT started_at, use_case, task_key, status, left(error_message, 40) AS error_message
FROM audit WHERE status = 'FAILED' AND started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS
""")
def recent_failures(spark: SparkSession, sf: str) -> DataFrame:
    failed = readiness.recent(audit_log(spark, sf), "started_at", AS_OF, 7,
                              F.col("status") == reports.RUN_FAILED)
    return failed.select("started_at", "use_case", "task_key", "status",
                         F.left("error_message", F.lit(40)).alias("error_message"))


@query(f"""{_AUDIT_SQL}
SELECT run_id, task_key, use_case, env, status, started_at, ended_at,
       left(error_message, 1000) AS error_message, round(seconds, 3) AS duration_seconds
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_key
        ORDER BY started_at DESC, use_case, env, status, ended_at, error_message NULLS LAST)
        AS rn FROM audit) WHERE rn = 1
""")
def latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latest_attempt(audit_log(spark, sf))


def load_log(spark: SparkSession, sf: str) -> DataFrame:
    """One table load per event; the row count is read from its metrics."""
    reported = F.when(F.col("event_type") == "error", "n/a") \
        .otherwise(F.get_json_object("props", "$.k"))
    metrics = F.create_map(F.lit("numOutputRows"), reported)
    return table(spark, sf, "events").select(
        date_key(F.col("ts")).cast("string").alias("run_id"), F.col("event_type").alias("source_id"),
        F.when(F.col("value") < 50, "us1").otherwise("us2").alias("use_case"),
        F.concat(F.lit("landing.t"), F.col("user_id").cast("string")).alias("target_table"),
        reports.reported_rows(metrics).alias("rows_written"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("ts").alias("loaded_at"))


_LOADS_SQL = """
WITH loads AS (
  SELECT strftime(ts, '%Y%m%d') AS run_id, event_type AS source_id,
         CASE WHEN value < 50 THEN 'us1' ELSE 'us2' END AS use_case,
         'landing.t' || user_id AS target_table,
         CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END
           AS rows_written,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         ts AS loaded_at
  FROM events)
"""


@query(f"""{_LOADS_SQL}
SELECT target_table, loaded_at, run_id, source_id, coalesce(rows_written, 0) AS rows_written
FROM (SELECT *, row_number() OVER (PARTITION BY target_table ORDER BY loaded_at DESC) AS rn
      FROM loads WHERE loaded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAYS) WHERE rn = 1
""")
def latest_load(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latest_load(load_log(spark, sf), before(AS_OF, days=5))


@query(f"""{_LOADS_SQL}
SELECT run_id, source_id, use_case, target_table, rows_written, status, loaded_at
FROM loads WHERE loaded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY ORDER BY loaded_at DESC
""")
def loads_since_yesterday(spark: SparkSession, sf: str) -> DataFrame:
    """Every load, newest first."""
    loads = readiness.recent(load_log(spark, sf), "loaded_at", AS_OF, 1, F.lit(True))
    return loads.orderBy(F.desc("loaded_at"), "run_id", "source_id", "target_table")


@query(f"""
SELECT ts AS evaluated_at, event_type AS expectation_name, 'us' || user_id AS use_case,
       CAST(event_id % 7 AS BIGINT) AS rows_failed
FROM events WHERE event_id % 7 <> 0 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS
""")
def failing_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of the last seven days that did not pass; each event is one check."""
    checks = table(spark, sf, "events").select(
        F.col("ts").alias("evaluated_at"), F.col("event_type").alias("expectation_name"),
        F.concat(F.lit("us"), F.col("user_id").cast("string")).alias("use_case"),
        (F.col("event_id") % 7).alias("rows_failed"))
    return readiness.recent(checks, "evaluated_at", AS_OF, 7, F.col("rows_failed") > 0)


@query(f"""{_LOADS_SQL}
SELECT run_id, use_case, count(*) AS n_loads,
       CAST(coalesce(sum(rows_written), 0) AS BIGINT) AS total_rows,
       count(*) FILTER (WHERE status = 'FAILED') AS failed_loads,
       max(loaded_at) AS last_loaded_at
FROM loads GROUP BY run_id, use_case
""")
def load_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.load_summary(load_log(spark, sf))


@query(f"SELECT * FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAYS")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return reports.retained(table(spark, sf, "events"), "ts", 10, AS_OF)


SEEN = "2024-02-26 00:00:00"


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is a table someone touched in a personal or shared schema."""
    kind = F.col("event_type")
    scope = (F.when(kind == "click", "us1").when(kind == "view", "audit")
             .when(kind == "purchase", "us22").when(kind == "signup", "scratch")
             .otherwise("config"))
    owner = F.concat(F.lit("dev_"), F.col("user_id").cast("string"))
    tables = table(spark, sf, "events").select(
        F.when(F.col("value") < 40, "lake_nonprod").otherwise("lakenonprod")
        .alias("table_catalog"),
        F.concat(owner, F.lit("_"), scope).alias("table_schema"),
        F.col("ts").alias("last_altered"))
    return reports.schema_inventory(tables, SEEN)


_INVENTORY_SQL = f"""
WITH tables AS (
  SELECT CASE WHEN value < 40 THEN 'lake_nonprod' ELSE 'lakenonprod' END AS table_catalog,
         'dev_' || user_id || '_' || CASE event_type
           WHEN 'click' THEN 'us1' WHEN 'view' THEN 'audit' WHEN 'purchase' THEN 'us22'
           WHEN 'signup' THEN 'scratch' ELSE 'config' END AS table_schema,
         ts AS last_altered
  FROM events),
inventory AS (
  SELECT table_catalog, table_schema, count(*) AS table_count,
         max(last_altered) AS last_touched,
         regexp_extract(table_schema, '{reports.OWNED_SCHEMA}', 1) AS owner_prefix,
         regexp_extract(table_schema, '{reports.OWNED_SCHEMA}', 2) AS scope,
         CAST(date_diff('day', CAST(max(last_altered) AS DATE), DATE '2024-02-26') AS INTEGER)
           AS days_idle
  FROM tables
  WHERE table_catalog LIKE '%!_nonprod' ESCAPE '!'
    AND regexp_matches(table_schema, '^.+_(us[0-9]+|audit|config|logs|recon)$')
  GROUP BY table_catalog, table_schema)
"""


@query(f"{_INVENTORY_SQL} SELECT * FROM inventory")
def schema_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf)


@query(f"""{_INVENTORY_SQL}
SELECT *, 'review ' || table_catalog || '.' || table_schema AS review_action
FROM inventory WHERE days_idle >= 30 ORDER BY days_idle DESC
""")
def staleness_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.stale_schemas(inventory(spark, sf), 30)


@query(f"""{_INVENTORY_SQL}
SELECT owner_prefix, count(DISTINCT table_catalog || '.' || table_schema) AS schemas,
       CAST(sum(table_count) AS BIGINT) AS tables, min(days_idle) AS days_since_last_activity
FROM inventory GROUP BY owner_prefix
""")
def footprint_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.footprint(inventory(spark, sf))
