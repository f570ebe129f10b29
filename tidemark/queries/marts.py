"""Dimensions, facts and contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import date_key, ntz
from tidemark.operators import contracts, dims
from tidemark.operators.dedupe import dedupe_latest
from tidemark.plans.keymap import KeyMap
from tidemark.queries.catalogue import AS_OF, query, table
from tidemark.queries.landing import CURATED_ORDERS_SQL, curated_orders
from tidemark.session import ensure_checkpoint_dir

# Day the dimension was last built: orders before it are known, later ones arrive.
BUILT = "1999-01-01"
# Few customers had ordered by then: most keys are still to be handed out.
EARLY = "1995-03-01"


def _latest_order(orders: DataFrame) -> DataFrame:
    """Each customer's last order, as the attributes of the customer."""
    newest = dedupe_latest(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return newest.select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("source_updated_at"))


def _known_and_arriving(spark: SparkSession, sf: str, day: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    dated = F.col("o_orderdate")
    return (_latest_order(orders.filter(dated < ntz(day))),
            _latest_order(orders.filter(dated >= ntz(day))))


def _latest_order_sql(condition: str) -> str:
    return f"""
  SELECT o_custkey AS customer_id, o_orderstatus AS status, o_orderpriority AS priority,
         o_orderdate AS source_updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
                    ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn
        FROM orders WHERE o_orderdate {condition}) WHERE rn = 1"""


@query(f"""
WITH t AS ({_latest_order_sql(f"< TIMESTAMP '{BUILT}'")}),
     s AS ({_latest_order_sql(f">= TIMESTAMP '{BUILT}'")}),
j AS (
  SELECT coalesce(t.customer_id, s.customer_id) AS customer_id,
         t.customer_id IS NULL OR (s.customer_id IS NOT NULL
           AND (t.status IS DISTINCT FROM s.status OR t.priority IS DISTINCT FROM s.priority))
           AS taken,
         t.status AS t_status, s.status AS s_status, t.priority AS t_priority,
         s.priority AS s_priority, t.source_updated_at AS t_at, s.source_updated_at AS s_at
  FROM t FULL JOIN s ON t.customer_id = s.customer_id)
SELECT customer_id, CASE WHEN taken THEN s_status ELSE t_status END AS status,
       CASE WHEN taken THEN s_priority ELSE t_priority END AS priority,
       CASE WHEN taken THEN s_at ELSE t_at END AS source_updated_at,
       CASE WHEN taken THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{BUILT}' END AS dw_updated_at
FROM j
""")
def dim_upsert(spark: SparkSession, sf: str) -> DataFrame:
    known, arriving = _known_and_arriving(spark, sf, BUILT)
    return dims.upsert(known.withColumn("dw_updated_at", ntz(BUILT)), arriving,
                       ["customer_id"], ["status", "priority"], ntz(AS_OF))


@query(f"""
WITH known AS (SELECT DISTINCT o_custkey AS c_custkey, o_custkey * 3 + 7 AS customer_key
               FROM orders WHERE o_orderdate < TIMESTAMP '{EARLY}'),
new AS (SELECT c_custkey,
               row_number() OVER (ORDER BY c_custkey)
                 + coalesce((SELECT max(customer_key) FROM known), 0) AS customer_key
        FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM known))
SELECT c.c_custkey, c.c_name, coalesce(k.customer_key, n.customer_key) AS customer_key
FROM customer c LEFT JOIN known k USING (c_custkey) LEFT JOIN new n USING (c_custkey)
""")
def surrogate_key(spark: SparkSession, sf: str) -> DataFrame:
    known = (
        table(spark, sf, "orders").filter(F.col("o_orderdate") < ntz(EARLY))
        .select(F.col("o_custkey").alias("c_custkey")).distinct()
        .withColumn("customer_key", F.col("c_custkey") * 3 + 7)
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return dims.assign_keys(known, customers, "c_custkey", "customer_key")


@query("""
WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 1
                                  WHEN c_custkey % 50 = 0 THEN 2 END AS batch FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY batch, c_custkey) AS customer_key FROM b WHERE batch IS NOT NULL
""")
def key_map(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that arrive in three batches, the later ones repeating known ones: keys are looked up in sorted runs
    and handed out to new customers; the runs are merged at the end."""
    keys = KeyMap(spark, f"{ensure_checkpoint_dir(spark)}/key-map-{uuid.uuid4().hex}", "c_custkey BIGINT", "customer_key")
    customers, number = table(spark, sf, "customer").select("c_custkey"), F.col("c_custkey")
    for batch in (number % 3 == 0, number % 3 <= 1, number % 50 == 0):
        keys.assign(customers.filter(batch))
    keys.merge()
    return keys.rows()


@query(f"""
WITH d AS ({_latest_order_sql(f"< TIMESTAMP '{EARLY}'")}),
     s AS ({_latest_order_sql(f">= TIMESTAMP '{EARLY}'")}),
old AS (SELECT *, 500 + row_number() OVER (ORDER BY customer_id) AS customer_key FROM d),
new AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id)
                 + coalesce((SELECT max(customer_key) FROM old), 0) AS customer_key
        FROM s WHERE customer_id NOT IN (SELECT customer_id FROM old)),
j AS (
  SELECT coalesce(t.customer_id, s.customer_id) AS customer_id,
         coalesce(t.customer_key, n.customer_key) AS customer_key,
         t.customer_id IS NULL OR (s.customer_id IS NOT NULL
           AND (t.status IS DISTINCT FROM s.status OR t.priority IS DISTINCT FROM s.priority))
           AS taken,
         t.status AS t_status, s.status AS s_status, t.priority AS t_priority,
         s.priority AS s_priority, t.source_updated_at AS t_at, s.source_updated_at AS s_at
  FROM old t FULL JOIN s ON t.customer_id = s.customer_id
  LEFT JOIN new n ON n.customer_id = s.customer_id)
SELECT customer_key, customer_id, CASE WHEN taken THEN s_status ELSE t_status END AS status,
       CASE WHEN taken THEN s_priority ELSE t_priority END AS priority,
       CASE WHEN taken THEN s_at ELSE t_at END AS source_updated_at,
       CASE WHEN taken THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{EARLY}' END AS dw_updated_at
FROM j
""")
def dim_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension with surrogate keys built once, then refreshed by what arrives."""
    known, arriving = _known_and_arriving(spark, sf, EARLY)
    built = dims.number_rows(known, "customer_id", 500).select(
        F.col("_number").cast("bigint").alias("customer_key"), *known.columns,
        ntz(EARLY).alias("dw_updated_at"))
    return dims.refresh(built, arriving, "customer_id", "customer_key", ["status", "priority"],
                        ntz(AS_OF))


@query(f"""
WITH t AS ({_latest_order_sql(f"< TIMESTAMP '{BUILT}'")}),
     s AS ({_latest_order_sql(">= TIMESTAMP '1995-01-01'")})
SELECT coalesce(s.customer_id, t.customer_id) AS customer_id,
       CASE WHEN s.customer_id IS NULL OR t.source_updated_at > s.source_updated_at
            THEN t.status ELSE s.status END AS status,
       CASE WHEN s.customer_id IS NULL OR t.source_updated_at > s.source_updated_at
            THEN t.priority ELSE s.priority END AS priority,
       CASE WHEN s.customer_id IS NULL OR t.source_updated_at > s.source_updated_at
            THEN t.source_updated_at ELSE s.source_updated_at END AS source_updated_at
FROM t FULL JOIN s ON t.customer_id = s.customer_id
""")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    known, _ = _known_and_arriving(spark, sf, BUILT)
    _, changes = _known_and_arriving(spark, sf, "1995-01-01")
    return dims.upsert_latest(known, changes, ["customer_id"], "source_updated_at")


# Customers in the red have no dimension row yet, so some facts are orphans.
def _dimension(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0)
    return customers.select(F.col("c_custkey").alias("o_custkey"),
                            (F.col("c_custkey") + 1000).alias("customer_key"))


@query("""
SELECT o.o_orderkey, o.o_custkey, c.c_custkey + 1000 AS customer_key,
       CAST(strftime(o.o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
       o.o_orderdate, o.o_totalprice
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c
  ON o.o_custkey = c.c_custkey
WHERE o.o_custkey IS NOT NULL
""")
def fact_build(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                               "o_totalprice")
    return dims.build_fact(orders, _dimension(spark, sf), "o_custkey", "customer_key",
                           "o_orderdate")


@query("""
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c
                  WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)
""")
def orphan_check(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return dims.orphans(orders, _dimension(spark, sf), "o_custkey")


@query("""
SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue,
       count(*) AS n_rows
FROM orders GROUP BY 1
""")
def agg_daily(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return dims.daily_totals(orders.withColumn("date_key", date_key(F.col("o_orderdate"))),
                             "o_totalprice")


ORDERS_CONTRACT = (
    "orders_id STRING NOT NULL, event_ts TIMESTAMP_NTZ, status STRING, amount DECIMAL(18,2), "
    "currency STRING, ingested_at TIMESTAMP_NTZ")


@query(CURATED_ORDERS_SQL)
def contract_write(spark: SparkSession, sf: str) -> DataFrame:
    shuffled = curated_orders(spark, sf).select(
        "ingested_at", "currency", "amount", "status", "event_ts", "orders_id")
    return contracts.enforce(shuffled, contracts.contract(ORDERS_CONTRACT))


@query("""
SELECT p_partkey, p_size, CASE WHEN p_size <= 10 THEN 'SMALL' ELSE p_type END AS size_band
FROM part
""")
def add_column_backfill(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    started = contracts.add_column(parts, "size_band", "string",
                                   F.when(F.col("p_size") <= 10, "SMALL"))
    return contracts.add_column(started, "size_band", "string", F.col("p_type")).drop("p_type")


@query("""
SELECT c_custkey, TRY_CAST(c_acctbal AS DECIMAL(5,2)) AS c_acctbal FROM customer
""")
def retype_column(spark: SparkSession, sf: str) -> DataFrame:
    """To a type that is too narrow for the larger balances."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return contracts.retype_column(customers, "c_acctbal", "decimal(5,2)")


@query("""
SELECT count(c_acctbal) AS n_values,
       count(*) FILTER (WHERE c_acctbal IS NOT NULL
                          AND TRY_CAST(c_acctbal AS DECIMAL(4,1)) IS NULL) AS n_lost,
       count(*) FILTER (WHERE CAST(TRY_CAST(c_acctbal AS DECIMAL(4,1)) AS DOUBLE)
                          <> c_acctbal) AS n_altered
FROM customer
""")
def lossy_casts(spark: SparkSession, sf: str) -> DataFrame:
    """What such a change would lose, and what it would round."""
    return contracts.lossy_casts(table(spark, sf, "customer"), "c_acctbal", "decimal(4,1)")
