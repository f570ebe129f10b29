"""Reconciliation of table pairs, and readiness to cut over."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.digests import md5_word
from tidemark.functions.times import date_key, ntz
from tidemark.operators import readiness as ready
from tidemark.operators import digest_tree, recon, sketches, streaks
from tidemark.queries.catalogue import AS_OF, query, table
from tidemark.session import ensure_checkpoint_dir

ORDER_CHECKS = (
    recon.Check("row_count", "row_count"),
    recon.Check("large_orders", "row_count", filter_expr="o_totalprice > 100000"),
    recon.Check("price_sum", "column_sum", "o_totalprice", 0.4, justification="open orders left"),
    recon.Check("large_price_sum", "column_sum", "o_totalprice",
                filter_expr="o_totalprice > 100000"),
    recon.Check("key_sum", "column_sum", "o_orderkey", 0.5, justification="open orders left"),
    recon.Check("customers", "distinct_count", "o_custkey"),
    recon.Check("priorities", "distinct_count", "o_orderpriority"),
    recon.Check("price_span", "min_max", "o_totalprice", 0.01, justification="few outliers"),
    recon.Check("date_span", "min_max", "o_orderdate"),
)
CUSTOMER_CHECKS = (
    recon.Check("row_count", "row_count", tolerance=0.15, justification="accounts in the red"),
    recon.Check("balance_sum", "column_sum", "c_acctbal"),
    recon.Check("segments", "distinct_count", "c_mktsegment"),
    recon.Check("nation_span", "min_max", "c_nationkey"),
)


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and the orders of a migrated table that left the open ones behind."""
    orders = table(spark, sf, "orders")
    return orders, orders.filter(F.col("o_orderstatus") != "P")


def _customers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf, "customer")
    return customers, customers.filter(F.col("c_acctbal") >= 0)


def _order_metrics_sql(where: str) -> str:
    return f"""
  SELECT m.check_name, CAST(m.metric AS DECIMAL(38,6)) AS metric FROM (
    SELECT count(*) AS a, count(*) FILTER (WHERE o_totalprice > 100000) AS b,
           sum(CAST(o_totalprice AS DECIMAL(38,6))) AS c,
           sum(CAST(o_totalprice AS DECIMAL(38,6))) FILTER (WHERE o_totalprice > 100000) AS d,
           sum(o_orderkey) AS e, count(DISTINCT o_custkey) AS f,
           count(DISTINCT o_orderpriority) AS g,
           CAST(max(o_totalprice) AS DECIMAL(38,6)) - CAST(min(o_totalprice) AS DECIMAL(38,6))
             AS h,
           (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 1000000 AS i
    FROM orders WHERE {where}), LATERAL (VALUES
      ('row_count', CAST(a AS DECIMAL(38,6))), ('large_orders', CAST(b AS DECIMAL(38,6))),
      ('price_sum', c), ('large_price_sum', d), ('key_sum', CAST(e AS DECIMAL(38,6))),
      ('customers', CAST(f AS DECIMAL(38,6))), ('priorities', CAST(g AS DECIMAL(38,6))),
      ('price_span', h), ('date_span', CAST(i AS DECIMAL(38,6)))) AS m(check_name, metric)"""


def _customer_metrics_sql(where: str) -> str:
    return f"""
  SELECT m.check_name, CAST(m.metric AS DECIMAL(38,6)) AS metric FROM (
    SELECT count(*) AS a, sum(CAST(c_acctbal AS DECIMAL(38,6))) AS b,
           count(DISTINCT c_mktsegment) AS c, max(c_nationkey) - min(c_nationkey) AS d
    FROM customer WHERE {where}), LATERAL (VALUES
      ('row_count', CAST(a AS DECIMAL(38,6))), ('balance_sum', b),
      ('segments', CAST(c AS DECIMAL(38,6))), ('nation_span', CAST(d AS DECIMAL(38,6))))
      AS m(check_name, metric)"""


@query(f"""
SELECT 'legacy' AS side, * FROM ({_order_metrics_sql('TRUE')})
UNION ALL
SELECT 'target', * FROM ({_order_metrics_sql("o_orderstatus <> 'P'")})
""")
def recon_metrics(spark: SparkSession, sf: str) -> DataFrame:
    legacy, target = (recon.measure(side, ORDER_CHECKS) for side in _orders(spark, sf))
    return (legacy.withColumn("side", F.lit("legacy"))
            .unionByName(target.withColumn("side", F.lit("target"))))


HASH_CHECKS = (
    recon.Check("name_hash", "column_hash", "c_name"),
    recon.Check("segment_hash", "column_hash", "segment"),
    recon.Check("nation_hash", "column_hash", "c_nationkey", filter_expr="c_acctbal >= 0"),
)


@query("""
WITH entry AS (  -- the 256 remainders of the standard reflected polynomial
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
                                     ELSE c >> 1 END) ORDER BY i) AS word
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
cell AS (
  SELECT 'name_hash' AS check_name, c_name AS t FROM customer
  UNION ALL
  SELECT 'segment_hash', CASE WHEN c_mktsegment = 'MACHINERY' THEN '<null>'
                              ELSE c_mktsegment END FROM customer
  UNION ALL
  SELECT 'nation_hash', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0),
hashed AS (
  SELECT check_name, t, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT),
                   list_transform(string_split(t, ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c >> 8, word[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM cell, entry)
SELECT check_name, CAST(sum(crc) AS DECIMAL(38,6)) AS crc_metric,
       CAST(sum(CAST('0x' || left(md5(t), 8) AS BIGINT)) AS DECIMAL(38,6)) AS md5_metric
FROM hashed GROUP BY check_name
""")
def recon_hash(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    customers = table(spark, sf, "customer").withColumn("segment", segment)
    crc = recon.measure(customers, HASH_CHECKS).withColumnRenamed("metric", "crc_metric")
    md5 = (recon.measure(customers, HASH_CHECKS, md5_word)
           .withColumnRenamed("metric", "md5_metric"))
    return crc.join(md5, "check_name")


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {"orders_curated": (_orders(spark, sf), ORDER_CHECKS),
             "customer_mart": (_customers(spark, sf), CUSTOMER_CHECKS)}
    parts = []
    for name, ((legacy, target), checks) in pairs.items():
        results = recon.compare(recon.measure(legacy, checks), recon.measure(target, checks),
                                checks)
        parts.append(results.withColumn("target_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


_COMPARED_SQL = f"""
WITH l AS (
  SELECT 'orders_curated' AS target_name, * FROM ({_order_metrics_sql('TRUE')})
  UNION ALL SELECT 'customer_mart', * FROM ({_customer_metrics_sql('TRUE')})),
t AS (
  SELECT 'orders_curated' AS target_name, * FROM ({_order_metrics_sql("o_orderstatus <> 'P'")})
  UNION ALL SELECT 'customer_mart', * FROM ({_customer_metrics_sql('c_acctbal >= 0')})),
k(target_name, check_name, check_type, tolerance) AS (VALUES
  ('orders_curated', 'row_count', 'row_count', 0.0::DOUBLE),
  ('orders_curated', 'large_orders', 'row_count', 0.0),
  ('orders_curated', 'price_sum', 'column_sum', 0.4),
  ('orders_curated', 'large_price_sum', 'column_sum', 0.0),
  ('orders_curated', 'key_sum', 'column_sum', 0.5),
  ('orders_curated', 'customers', 'distinct_count', 0.0),
  ('orders_curated', 'priorities', 'distinct_count', 0.0),
  ('orders_curated', 'price_span', 'min_max', 0.01),
  ('orders_curated', 'date_span', 'min_max', 0.0),
  ('customer_mart', 'row_count', 'row_count', 0.15),
  ('customer_mart', 'balance_sum', 'column_sum', 0.0),
  ('customer_mart', 'segments', 'distinct_count', 0.0),
  ('customer_mart', 'nation_span', 'min_max', 0.0)),
r AS (
  SELECT k.*, l.metric AS legacy_metric, t.metric AS target_metric,
         CAST(l.metric - t.metric AS DECIMAL(38,6)) AS difference,
         CASE WHEN l.metric <> 0 THEN abs(CAST(l.metric - t.metric AS DOUBLE))
                                      / abs(CAST(l.metric AS DOUBLE)) END AS relative_diff
  FROM k JOIN l USING (target_name, check_name) JOIN t USING (target_name, check_name)),
v AS (
  SELECT *, CASE WHEN legacy_metric = target_metric THEN TRUE
                 WHEN tolerance = 0 OR legacy_metric = 0 THEN FALSE
                 ELSE relative_diff <= tolerance END AS passed
  FROM r)
"""


@query(f"""{_COMPARED_SQL}
SELECT target_name, check_name, check_type, legacy_metric, target_metric, difference,
       round(relative_diff, 9) AS relative_diff, tolerance, passed FROM v
""")
def recon_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).select(
        "target_name", "check_name", "check_type", "legacy_metric", "target_metric",
        "difference", F.round("relative_diff", 9).alias("relative_diff"), "tolerance", "passed")


@query(f"""{_COMPARED_SQL}
SELECT target_name, CAST(count(*) AS INTEGER) AS checks_total,
       CAST(count(*) FILTER (WHERE passed) AS INTEGER) AS checks_passed,
       CAST(count(*) FILTER (WHERE NOT passed) AS INTEGER) AS checks_failed,
       bool_and(passed) AS overall_passed,
       CASE WHEN bool_and(passed) THEN 'PASSED' ELSE 'FAILED' END AS status
FROM v GROUP BY target_name
""")
def recon_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return recon.rollup(_compared(spark, sf), ["target_name"])


@query(f"""{_COMPARED_SQL}
SELECT target_name, check_name, legacy_metric, target_metric, difference,
       round(relative_diff, 9) AS relative_diff, TIMESTAMP '{AS_OF}' AS evaluated_at
FROM v WHERE NOT passed ORDER BY evaluated_at DESC
""")
def recon_failures(spark: SparkSession, sf: str) -> DataFrame:
    results = _compared(spark, sf).withColumn("evaluated_at", ntz(AS_OF))
    return ready.failures(results, AS_OF, 7).select(
        "target_name", "check_name", "legacy_metric", "target_metric", "difference",
        F.round("relative_diff", 9).alias("relative_diff"), "evaluated_at")


def _edited_customers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two editions of the customers: rows missing on either side, segments recoded."""
    customers = table(spark, sf, "customer")
    recoded = (F.when(F.col("c_nationkey") == 7, F.lower("c_mktsegment"))
               .when(F.col("c_nationkey") == 11, F.lit(None))
               .otherwise(F.col("c_mktsegment")))
    return (customers.filter(F.col("c_acctbal") <= 9500),
            customers.filter(F.col("c_acctbal") >= -500).withColumn("c_mktsegment", recoded))


_DIFFERENCES_SQL = """
WITH l AS (SELECT * FROM customer WHERE c_acctbal <= 9500),
t AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal,
             CASE c_nationkey WHEN 7 THEN lower(c_mktsegment) WHEN 11 THEN NULL
                              ELSE c_mktsegment END AS c_mktsegment
      FROM customer WHERE c_acctbal >= -500),
j AS (SELECT coalesce(l.c_custkey, t.c_custkey) AS c_custkey, l.c_custkey AS lk,
             t.c_custkey AS tk, l.c_mktsegment AS ls, t.c_mktsegment AS ts
      FROM l FULL JOIN t ON l.c_custkey = t.c_custkey),
d AS (
  SELECT c_custkey, 'missing_in_target' AS check_name, 'present' AS legacy_value,
         NULL AS target_value FROM j WHERE tk IS NULL
  UNION ALL
  SELECT c_custkey, 'missing_in_legacy', NULL, 'present' FROM j WHERE lk IS NULL
  UNION ALL
  SELECT c_custkey, 'c_mktsegment', ls, ts FROM j
  WHERE lk IS NOT NULL AND tk IS NOT NULL AND ls IS DISTINCT FROM ts)
"""


@query(f"""{_DIFFERENCES_SQL}
SELECT check_name, c_custkey, 'c_custkey=' || c_custkey AS key_text, legacy_value, target_value
FROM (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY c_custkey) AS rn FROM d)
WHERE rn <= 20
""")
def recon_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    """A capped sample per check, which is what the exception table is for."""
    legacy, target = _edited_customers(spark, sf)
    found = recon.exceptions(legacy, target, ["c_custkey"],
                             ["c_name", "c_nationkey", "c_mktsegment"], limit=20)
    pairs = F.transform(F.map_entries("key_values"),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("check_name", "c_custkey", F.array_join(pairs, ",").alias("key_text"),
                        "legacy_value", "target_value")


@query(f"{_DIFFERENCES_SQL} SELECT * FROM d")
def recon_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Every mismatch, without a cap."""
    legacy, target = _edited_customers(spark, sf)
    return recon.differences(legacy, target, ["c_custkey"],
                             ["c_name", "c_nationkey", "c_mktsegment"])


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(l_quantity) AS q
           FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(l_quantity) AS q
      FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
SELECT CASE WHEN l.n > 1 OR t.n > 1 THEN 'duplicate_key' ELSE 'missing_in_target' END
         AS check_name,
       count(*) AS n_keys, CAST(sum(l.n) AS BIGINT) AS legacy_copies
FROM l LEFT JOIN t USING (l_orderkey, l_linenumber)
WHERE l.n > 1 OR t.n > 1 OR t.n IS NULL GROUP BY 1
""")
def recon_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated business keys are findings of their own and never multiply."""
    legacy = table(spark, sf, "lineitem")
    found = recon.differences(legacy, legacy.filter(F.col("l_returnflag") != "R"),
                              ["l_orderkey", "l_linenumber"], ["l_quantity"])
    copies = F.when(F.col("check_name") == recon.DUPLICATE_KEY,
                    F.col("legacy_value").try_cast("bigint")).otherwise(1)
    return found.groupBy("check_name").agg(F.count(F.lit(1)).alias("n_keys"),
                                           F.sum(copies).alias("legacy_copies"))


# -- readiness: events read as a log of parity runs --------------------------------


def parity_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per user and day; each event of it is one target's outcome."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(kind == "signup", "SKIPPED") \
        .otherwise("PASSED")
    day = F.col("ts").cast("date").cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        F.concat(F.lit("us"), F.col("user_id").cast("string")).alias("use_case"),
        F.lit("preprod").alias("env"),
        date_key(day).cast("string").alias("recon_run_id"), day.alias("started_at"),
        F.col("event_id").cast("string").alias("target_name"), status.alias("status"),
        (status == "PASSED").alias("overall_passed"), F.col("props").alias("notes"))


_RUNS_SQL = """
WITH targets AS (
  SELECT 'us' || user_id AS use_case, 'preprod' AS env,
         strftime(ts, '%Y%m%d') AS recon_run_id, date_trunc('day', ts) AS started_at,
         CAST(event_id AS VARCHAR) AS target_name, props AS notes,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'SKIPPED'
                         ELSE 'PASSED' END AS status
  FROM events),
runs AS (
  SELECT use_case, env, recon_run_id, started_at, bool_and(status = 'PASSED') AS run_clean,
         bool_or(status = 'SKIPPED') AS run_skipped, count(*) AS targets_checked
  FROM targets GROUP BY ALL),
streaks AS (
  SELECT use_case, env, count(*) FILTER (WHERE breaks = 0) AS clean_streak
  FROM (SELECT *, sum(CASE WHEN run_clean THEN 0 ELSE 1 END)
                    OVER (PARTITION BY use_case, env ORDER BY started_at DESC) AS breaks
        FROM runs) GROUP BY ALL)
"""


@query(f"""{_RUNS_SQL}
SELECT use_case, env, count(*) AS total_runs, count(*) FILTER (WHERE run_clean) AS clean_runs,
       count(*) FILTER (WHERE run_skipped) AS skipped_runs, max(started_at) AS last_run_at,
       arg_max(run_clean, started_at) AS last_run_clean,
       arg_max(run_skipped, started_at) AS last_run_skipped,
       arg_max(targets_checked, started_at) AS targets_in_last_run
FROM runs GROUP BY use_case, env
""")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    return ready.readiness(parity_runs(spark, sf))


@query(f"{_RUNS_SQL} SELECT * FROM streaks")
def clean_streak(spark: SparkSession, sf: str) -> DataFrame:
    return ready.clean_streak(parity_runs(spark, sf))


@query("""
WITH runs AS (SELECT 'us' || user_id % 20 AS use_case, date_trunc('hour', ts) AS started, bool_and(value < 99) AS clean
              FROM events GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN clean THEN 0 ELSE 1 END) OVER (PARTITION BY use_case ORDER BY started) AS breaks_before,
             sum(CASE WHEN clean THEN 0 ELSE 1 END) OVER (PARTITION BY use_case ORDER BY started DESC) AS breaks_since FROM runs)
SELECT use_case, 'prod' AS env, count(*) AS runs, count(*) FILTER (WHERE breaks_before = 0) AS first_streak,
       count(*) FILTER (WHERE breaks_since = 0) AS clean_streak, TRUE AS cut_elsewhere_too
FROM r GROUP BY use_case
""")
def streak_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Streaks of hourly runs from one state a day: the first ten days are kept, the others are added without reading
    those again. Merged by the week first, they come to the same."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    targets = table(spark, sf, "events").select(
        F.concat(F.lit("us"), (F.col("user_id") % 20).cast("string")).alias("use_case"), F.lit("prod").alias("env"),
        hour.cast("string").alias("recon_run_id"), hour.alias("started_at"), (F.col("value") < 99).alias("overall_passed"),
        F.lit("PASSED").alias("status"))
    root, cut = f"{ensure_checkpoint_dir(spark)}/streaks-{uuid.uuid4().hex}", date(2024, 1, 11)
    streaks.by_day(targets.where(F.col("started_at") < F.lit(cut).cast("timestamp_ntz"))).write.parquet(f"{root}/first")
    streaks.extended(spark.read.parquet(f"{root}/first"), targets, cut).write.parquet(f"{root}/state")
    state = spark.read.parquet(f"{root}/state")
    weekly = streaks.clean_streak(streaks.merged(state, F.date_trunc("week", "day"))).select(
        "use_case", "env", F.col("clean_streak").alias("_weekly"))
    return streaks.merged(state).join(weekly, ["use_case", "env"]).select(
        "use_case", "env", "runs", F.col("prefix").alias("first_streak"), F.col("suffix").alias("clean_streak"),
        (F.col("suffix") == F.col("_weekly")).alias("cut_elsewhere_too"))


@query(f"""{_RUNS_SQL},
skips AS (SELECT use_case, env, count(*) FILTER (WHERE status = 'SKIPPED'
             AND started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAYS) AS skipped_in_window
          FROM targets GROUP BY ALL),
bad AS (SELECT 'us' || user_id AS use_case, 'preprod' AS env, count(*) AS n FROM events
        WHERE value > 90 AND event_type <> 'view'
          AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAYS GROUP BY ALL)
SELECT s.use_case, s.env, s.clean_streak, k.skipped_in_window,
       coalesce(b.n, 0) AS breaches_in_window,
       s.clean_streak >= 2 AND k.skipped_in_window = 0 AND coalesce(b.n, 0) = 0 AS cleared
FROM streaks s JOIN skips k USING (use_case, env) LEFT JOIN bad b USING (use_case, env)
""")
def cutover_gate(spark: SparkSession, sf: str) -> DataFrame:
    quality = table(spark, sf, "events").select(
        F.concat(F.lit("us"), F.col("user_id").cast("string")).alias("use_case"),
        F.lit("preprod").alias("env"), (F.col("value") <= 90).alias("passed"),
        F.when(F.col("event_type") == "view", "warn").otherwise("error").alias("severity"),
        F.col("ts").alias("evaluated_at"))
    return ready.cutover_gate(parity_runs(spark, sf), quality, 2, AS_OF, days=3)


@query(f"""{_RUNS_SQL}
SELECT use_case, env, count(*) AS runs, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped,
       max(started_at) AS last_run
FROM targets WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAYS GROUP BY use_case, env
""")
def recon_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return ready.coverage(parity_runs(spark, sf), AS_OF, 20)


@query(f"""{_RUNS_SQL}
SELECT recon_run_id, target_name, status, notes, started_at
FROM targets WHERE status = 'SKIPPED'
ORDER BY started_at DESC, recon_run_id, target_name LIMIT 10
""")
def latest_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return ready.latest_skipped(parity_runs(spark, sf)).select(
        "recon_run_id", "target_name", "status", "notes", "started_at")


TYPED_CHECKS = tuple(check for column in ("o_orderkey", "o_totalprice", "ordered", "o_custkey") for check in (
    recon.Check(f"{column}_hash", "column_hash", column), recon.Check(f"{column}_count", "distinct_count", column)))


@query("""
WITH m AS (SELECT count(*) FILTER (
                    WHERE CAST(o_orderkey AS DECIMAL(38,10)) <> o_orderkey) AS a,
                  count(*) FILTER (WHERE CAST(o_totalprice AS DECIMAL(18,2)) <> o_totalprice) AS b,
                  count(*) FILTER (WHERE CAST(o_orderdate AS DATE)::TIMESTAMP <>
                                         date_trunc('day', o_orderdate)) AS c,
                  count(*) FILTER (WHERE CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) <> o_custkey) AS d
           FROM orders)
SELECT column_name, check_type, differing = 0 AS passed FROM m, LATERAL (VALUES
  ('o_orderkey', a), ('o_totalprice', b), ('ordered', c), ('o_custkey', d)) AS v(column_name, differing),
  LATERAL (VALUES ('column_hash'), ('distinct_count')) AS k(check_type)
UNION ALL
SELECT 'rows that differ', 'exceptions', sum(a + b + c + d) = 0 FROM m
""")
def parity_across_types(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against themselves as another system would store them."""
    orders = table(spark, sf, "orders").withColumn("ordered", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    other = orders.withColumns({
        "o_orderkey": F.col("o_orderkey").cast("decimal(38,10)"),
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
        "ordered": F.col("ordered").cast("date"), "o_custkey": F.col("o_custkey").cast("string")})
    compared = recon.compare(recon.measure(orders, TYPED_CHECKS), recon.measure(other, TYPED_CHECKS), TYPED_CHECKS)
    found = recon.exceptions(orders, other, ["o_orderkey"], ["o_totalprice", "ordered", "o_custkey"])
    none = found.agg((F.count(F.lit(1)) == 0).alias("passed")).select(
        F.lit("rows that differ").alias("column_name"), F.lit("exceptions").alias("check_type"), "passed")
    return compared.select("column_name", "check_type", "passed").unionByName(none)


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice AS price, date_trunc('day', o_orderdate) AS day, o_custkey AS cust,
                  o_orderkey % 211 AS r FROM orders),
c AS (SELECT o_orderkey, price, day, cust,
             CASE WHEN r = 3 THEN price + 0.01 ELSE price END AS price2,
             CASE WHEN r = 5 THEN day + INTERVAL 1 DAY ELSE day END AS day2,
             CASE WHEN r IN (3, 7) THEN cust + 1000000000 ELSE cust END AS cust2 FROM o)
SELECT 'o_orderkey' AS column_name, 'column_hash' AS check_type, TRUE AS passed, CAST(0 AS BIGINT) AS n_rows
UNION ALL SELECT 'o_totalprice', 'column_hash', count(*) FILTER (price <> price2) = 0, count(*) FILTER (price <> price2) FROM c
UNION ALL SELECT 'ordered', 'column_hash', count(*) FILTER (day <> day2) = 0, count(*) FILTER (day <> day2) FROM c
UNION ALL SELECT 'o_custkey', 'column_hash', count(*) FILTER (cust <> cust2) = 0, count(*) FILTER (cust <> cust2) FROM c
UNION ALL SELECT 'o_custkey', 'distinct_count', count(DISTINCT cust) = count(DISTINCT cust2), count(*) FILTER (cust <> cust2) FROM c
""")
def parity_across_types_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against a copy in other types that differs in a few prices, days and customers: the checks of those columns
    fail, that of the key passes, and as many rows are found as were changed."""
    orders = table(spark, sf, "orders").withColumn("ordered", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    rest = F.col("o_orderkey") % 211
    price = F.col("o_totalprice").cast("decimal(18,2)")
    customer = F.when(rest.isin(3, 7), F.col("o_custkey") + 1000000000).otherwise(F.col("o_custkey"))
    other = orders.withColumns({
        "o_totalprice": F.when(rest == 3, price + F.lit("0.01").cast("decimal(3,2)")).otherwise(price).cast("decimal(18,2)"),
        "ordered": F.date_add(F.col("ordered").cast("date"), F.when(rest == 5, 1).otherwise(0)),
        "o_custkey": customer.cast("string"), "o_orderkey": F.col("o_orderkey").cast("decimal(38,10)")})
    checks = [c for c in TYPED_CHECKS if c.check_type == "column_hash" or c.name == "o_custkey_count"]
    compared = recon.compare(recon.measure(orders, checks), recon.measure(other, checks), checks)
    found = recon.differences(orders, other, ["o_orderkey"], ["o_totalprice", "ordered", "o_custkey"]).groupBy(
        F.col("check_name").alias("column_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return compared.select("column_name", "check_type", "passed").join(found, "column_name", "left").fillna(0, "n_rows")


@query("""
WITH m AS (SELECT *, (l_orderkey * 7 + l_linenumber) % 5003 AS r FROM lineitem)
SELECT DISTINCT l_orderkey, l_linenumber, 'changed' AS status FROM m WHERE r IN (13, 29)
UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, 'only_left' FROM m WHERE r = 17
UNION ALL SELECT DISTINCT -l_orderkey, l_linenumber, 'only_right' FROM m WHERE r = 19
""")
def digest_tree_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines against a copy stored in other types, with a few lines changed, lost and added: found by
    descending from bucket sums into the few buckets that differ."""
    lines = table(spark, sf, "lineitem")
    planted = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(5003))
    copy = (lines.filter(planted != 17)
            .withColumn("l_quantity", F.when(planted == 13, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
            .withColumn("l_comment", F.when(planted == 29, F.lit(None)).otherwise(F.col("l_returnflag"))))
    lines = lines.withColumn("l_comment", F.col("l_returnflag"))
    copy = copy.unionByName(copy.filter(planted == 19).withColumn("l_orderkey", -F.col("l_orderkey")))
    copy = copy.withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,4)"))
    keys, columns = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_comment", "l_shipdate", "l_extendedprice"]
    root = f"{ensure_checkpoint_dir(spark)}/digest-tree-{uuid.uuid4().hex}"
    fan = digest_tree.Fan(buckets=64)
    left = digest_tree.store(lines, f"{root}/left", keys, columns, fan)
    right = digest_tree.store(copy, f"{root}/right", keys, columns, fan)
    return digest_tree.compare(left, right, keys).rows


@query("""
WITH e AS (SELECT * FROM events),
n AS (SELECT count(DISTINCT user_id) AS a, count(DISTINCT event_id) AS b, count(DISTINCT CAST(ts AS DATE)) AS d, count(*) AS r FROM e)
SELECT name AS column_name, d AS n_days, r AS n_rows, exact, TRUE AS within FROM n, LATERAL (VALUES ('user_id', a), ('event_id', b)) AS v(name, exact)
""")
def distinct_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct counts merged from one sketch a day: half of the days are kept as state first, the others are added
    without reading those again. Beside them the exact counts, and whether they are within four standard errors."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    columns = ["user_id", "event_id"]
    root = f"{ensure_checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    sketches.daily(events.filter(F.dayofmonth("day") % 2 == 0), "day", columns).write.parquet(f"{root}/first")
    state = sketches.extended(spark.read.parquet(f"{root}/first"), events, "day", columns)
    state.write.parquet(f"{root}/state")
    state = spark.read.parquet(f"{root}/state")
    n_days = state.count()
    exact = events.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    near = lambda c: F.abs(F.col(c) - exact[c]) <= 4 * sketches.error() * exact[c]
    return sketches.estimates(state, columns).select(
        F.lit(n_days).cast("long").alias("n_days"), F.col("rows").alias("n_rows"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(exact[c]).cast("long").alias("exact"), near(c).alias("within"))
            for c in columns])).alias("v")).select("v.column_name", "n_days", "n_rows", "v.exact", "v.within")
