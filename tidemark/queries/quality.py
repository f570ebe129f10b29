"""Expectations, quarantine and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as q
from tidemark.queries.catalogue import query, table

CUSTOMER_CHECKS = (
    q.not_null("c_name"),
    q.in_set("c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]),
    q.non_negative("c_acctbal"),
    q.Expectation("balance_by_nation", "c_acctbal < 9000 OR c_nationkey <> 3", "warn"),
    # NULL for one segment, which counts as a violation.
    q.Expectation("segment_known", "nullif(c_mktsegment, 'MACHINERY') <> 'NONE'", "warn"),
)

_CUSTOMER_FAILURES = """
  count(*) FILTER (WHERE c_name IS NULL) AS f1,
  count(*) FILTER (WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN
                   ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD')) AS f2,
  count(*) FILTER (WHERE c_acctbal IS NULL OR c_acctbal < 0) AS f3,
  count(*) FILTER (WHERE NOT coalesce(c_acctbal < 9000 OR c_nationkey <> 3, FALSE)) AS f4,
  count(*) FILTER (WHERE c_mktsegment IS NULL OR c_mktsegment = 'MACHINERY') AS f5"""

_COLUMNS = ("expectation_name", "severity", "rows_evaluated", "rows_failed", "passed")


@query(f"""
WITH a AS (
  SELECT count(*) AS n, {_CUSTOMER_FAILURES},
         (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1))
           AS f6,
         (SELECT count(*) FROM (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY 1, 2
                                HAVING count(*) > 1)) AS f7
  FROM customer)
SELECT e.name AS expectation_name, e.severity, a.n AS rows_evaluated, e.failed AS rows_failed,
       e.failed = 0 AS passed
FROM a, LATERAL (VALUES
  ('c_name_not_null', 'error', f1), ('c_mktsegment_in_set', 'error', f2),
  ('c_acctbal_non_negative', 'error', f3), ('balance_by_nation', 'warn', f4),
  ('segment_known', 'warn', f5), ('c_custkey_unique', 'error', f6),
  ('c_nationkey_c_mktsegment_unique', 'warn', f7)) AS e(name, severity, failed)
""")
def dq_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    checks = [*CUSTOMER_CHECKS, q.unique("c_custkey"),
              q.unique("c_nationkey", "c_mktsegment", severity="warn")]
    return q.evaluate(table(spark, sf, "customer"), checks).select(*_COLUMNS)


@query("""
WITH a AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE ts IS NULL) AS f1,
         count(*) FILTER (WHERE event_type IS NULL
                          OR event_type NOT IN ('click', 'view', 'purchase')) AS f2,
         count(*) FILTER (WHERE value IS NULL OR value < 0) AS f3,
         (SELECT count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1))
           AS f4,
         (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1))
           AS f5
  FROM events)
SELECT e.name AS expectation_name, e.severity, a.n AS rows_evaluated, e.failed AS rows_failed,
       e.failed = 0 AS passed
FROM a, LATERAL (VALUES
  ('ts_not_null', 'error', f1), ('event_type_in_set', 'warn', f2),
  ('value_non_negative', 'error', f3), ('event_id_unique', 'error', f4),
  ('user_id_unique', 'error', f5)) AS e(name, severity, failed)
""")
def dq_events(spark: SparkSession, sf: str) -> DataFrame:
    checks = [q.not_null("ts"), q.in_set("event_type", ["click", "view", "purchase"], "warn"),
              q.non_negative("value"), q.unique("event_id"), q.unique("user_id")]
    return q.evaluate(table(spark, sf, "events"), checks).select(*_COLUMNS)


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n_copies
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def dq_unique(spark: SparkSession, sf: str) -> DataFrame:
    return q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""
WITH a AS (SELECT count(*) AS n, {_CUSTOMER_FAILURES} FROM customer),
b AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_name IS NULL) AS f1,
             count(*) FILTER (WHERE s_acctbal IS NULL OR s_acctbal < 0) AS f2 FROM supplier),
r AS (
  SELECT 'customer' AS table_name, e.*, a.n FROM a, LATERAL (VALUES
    ('c_name_not_null', 'error', f1), ('c_mktsegment_in_set', 'error', f2),
    ('c_acctbal_non_negative', 'error', f3), ('balance_by_nation', 'warn', f4),
    ('segment_known', 'warn', f5)) AS e(name, severity, failed)
  UNION ALL
  SELECT 'supplier', e.*, b.n FROM b, LATERAL (VALUES
    ('s_name_not_null', 'error', f1), ('s_acctbal_non_negative', 'error', f2))
    AS e(name, severity, failed))
SELECT table_name, name AS expectation_name, severity, n AS rows_evaluated,
       failed AS rows_failed, failed = 0 AS passed
FROM r ORDER BY passed, table_name, expectation_name
""")
def dq_report(spark: SparkSession, sf: str) -> DataFrame:
    customer = q.evaluate(table(spark, sf, "customer"), CUSTOMER_CHECKS)
    supplier = q.evaluate(table(spark, sf, "supplier"),
                          [q.not_null("s_name"), q.non_negative("s_acctbal")])
    results = (customer.withColumn("table_name", F.lit("customer"))
               .unionByName(supplier.withColumn("table_name", F.lit("supplier"))))
    return q.report(results.select("table_name", *_COLUMNS))


@query("""
SELECT *, array_to_string(list_filter([
    CASE WHEN c_name IS NULL THEN 'c_name_not_null' END,
    CASE WHEN c_mktsegment IS NULL OR c_mktsegment NOT IN
           ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') THEN 'c_mktsegment_in_set' END,
    CASE WHEN c_acctbal IS NULL OR c_acctbal < 0 THEN 'c_acctbal_non_negative' END,
    CASE WHEN NOT coalesce(c_acctbal < 9000 OR c_nationkey <> 3, FALSE)
         THEN 'balance_by_nation' END,
    CASE WHEN c_mktsegment IS NULL OR c_mktsegment = 'MACHINERY' THEN 'segment_known' END],
  lambda x: x IS NOT NULL), ',') AS failed_checks
FROM customer
WHERE c_name IS NULL OR c_mktsegment IS NULL
   OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD')
   OR c_acctbal IS NULL OR c_acctbal < 0
""")
def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = q.split(table(spark, sf, "customer"), CUSTOMER_CHECKS)
    return (rejected.withColumn("failed_checks", F.array_join("_failed_checks", ","))
            .drop("_failed_checks"))


@query("""
SELECT * FROM customer
WHERE c_name IS NOT NULL AND c_acctbal >= 0
  AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD')
""")
def quarantine_kept(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = q.split(table(spark, sf, "customer"), CUSTOMER_CHECKS)
    return kept


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_dropped,
       count(*) FILTER (WHERE event_type = 'view') AS n_warned
FROM events
""")
def stream_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """The counts a stream reports for a dropped and a warned expectation."""
    landed = table(spark, sf, "events").select(
        F.when(F.col("event_type") != "error", F.col("event_id")).alias("kafka_offset"),
        F.when(F.col("event_type") != "view", F.col("props")).otherwise("").alias("payload"))
    rules = [q.not_null("kafka_offset"),
             q.Expectation("payload_not_empty", "payload IS NOT NULL AND length(payload) > 0",
                           "warn")]
    return landed.agg(*q.violation_counts(rules)).toDF("n_rows", "n_dropped", "n_warned")


@query("""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE event_type = 'error') AS undated_rows
FROM events
""")
def curated_gate(spark: SparkSession, sf: str) -> DataFrame:
    dated = table(spark, sf, "events").select(
        F.when(F.col("event_type") != "error", F.col("ts")).alias("event_ts"))
    return q.undated(dated, "event_ts")
