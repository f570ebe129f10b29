"""Extract, land, parse, conform, dedupe."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import join_keys, snake_case_columns, split_keys
from tidemark.functions.times import ntz
from tidemark.operators.conform import CORRUPT, MISSING, Field, conform as conform_rows
from tidemark.operators.conform import parse_payload as parse
from tidemark.operators.conform import unknown_values as unknown
from tidemark.operators.dedupe import dedupe_latest as latest
from tidemark.operators.dims import upsert_latest
from tidemark.operators.drift import drift, shapes
from tidemark.operators.lineage import stamp
from tidemark.operators.quality import Expectation
from tidemark.plans.daily import DailyTable
from tidemark.queries.catalogue import AS_OF, query, table
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import files, registry
from tidemark.sources.jdbc import newer_than
from tidemark.sources.kafka import decode_envelope as decode
from tidemark.sources.splits import Split, points_from
from tidemark.streaming import landing as streams
from tidemark.streaming.replays import OnceLanding

# The statuses a curated table understands.
STATUSES = ("NEW", "ACTIVE", "SETTLED", "CANCELLED")


@query("SELECT * FROM orders")
def full_extract(spark: SparkSession, sf: str) -> DataFrame:
    return newer_than(table(spark, sf, "orders"), None, None)


@query("SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'")
def incremental_extract(spark: SparkSession, sf: str) -> DataFrame:
    return newer_than(table(spark, sf, "orders"), "o_orderdate", datetime(2000, 1, 1))


@query(f"""
WITH b AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) + 1 AS hi FROM lineitem),
s AS (
  SELECT l_orderkey, {' + '.join(
      f'CASE WHEN l_orderkey >= lo + (hi - lo) * {i} // 8 THEN 1 ELSE 0 END'
      for i in range(1, 8))} AS split_no
  FROM lineitem, b)
SELECT CAST(split_no AS INTEGER) AS split_no, count(*) AS n_rows,
       min(l_orderkey) AS min_key, max(l_orderkey) AS max_key
FROM s GROUP BY split_no
""")
def partitioned_extract(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey")
    low, high = rows.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    split = Split("l_orderkey", low, high + 1, 8)
    return rows.groupBy(split.number().alias("split_no")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("l_orderkey").alias("min_key"),
        F.max("l_orderkey").alias("max_key"))


@query(f"""
SELECT *, TIMESTAMP '{AS_OF}' AS _ingested_at, 'crm_customer' AS _source_id, 'run-1' AS _run_id
FROM customer
""")
def lineage_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return stamp(table(spark, sf, "customer"), "crm_customer", "run-1", ntz(AS_OF))


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the shape a topic delivers them."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.col("props").cast("binary").alias("value"),
        F.lit("events").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
    )


@query(f"""
SELECT CAST(user_id AS VARCHAR) AS kafka_key, props AS payload, 'events' AS kafka_topic,
       CAST(user_id % 4 AS INTEGER) AS kafka_partition, event_id AS kafka_offset,
       ts AS kafka_timestamp, TIMESTAMP '{AS_OF}' AS _ingested_at
FROM events
""")
def decode_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return decode(event_records(spark, sf), ntz(AS_OF))


@query("""
SELECT s_suppkey AS party_id, s_name AS party_name, s_acctbal AS balance, NULL AS segment
FROM supplier
UNION ALL
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
""")
def schema_merge_read(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("party_name"),
        F.col("s_acctbal").alias("balance"))
    customers = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        F.col("c_custkey").alias("party_id"), F.col("c_name").alias("party_name"))
    return files.united(suppliers, customers)


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def bounded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return files.bounded_sample(table(spark, sf, "orders"), "o_orderkey", 1000)


@query("""
SELECT 'part_' || p_partkey AS source_id, p_brand AS use_case,
       CASE WHEN p_type = 'ECONOMY' THEN 'kafka' ELSE 'oracle' END AS source_system,
       p_size <= 40 AS is_active
FROM part
WHERE p_size <= 40 AND p_brand = 'Brand#2' AND p_type <> 'ECONOMY'
""")
def active_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("source_id"),
        F.col("p_brand").alias("use_case"),
        F.when(F.col("p_type") == "ECONOMY", "kafka").otherwise("oracle").alias("source_system"),
        (F.col("p_size") <= 40).alias("is_active"))
    return registry.active_sources(rows, use_case="Brand#2", source_system="oracle")


@query("""
WITH p AS (
  SELECT event_id, CASE event_type
           WHEN 'error' THEN left(props, length(props) - 1)
           WHEN 'signup' THEN replace(props, '"k"', '"kk"')
           ELSE props END AS payload
  FROM events)
SELECT event_id,
       CASE WHEN json_valid(payload) THEN CAST(json_extract(payload, '$.k') AS INTEGER) END AS k,
       CASE WHEN NOT json_valid(payload) THEN payload END AS corrupt_record,
       CASE WHEN json_valid(payload) AND NOT json_exists(payload, '$.k') THEN 'k' END
         AS missing_fields
FROM p
""")
def parse_payload(spark: SparkSession, sf: str) -> DataFrame:
    props = F.col("props")
    payload = (
        F.when(F.col("event_type") == "error", F.left(props, F.length(props) - 1))
        .when(F.col("event_type") == "signup", F.replace(props, F.lit('"k"'), F.lit('"kk"')))
        .otherwise(props)
    )
    landed = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    return parse(landed, "k INT", keep=["event_id"]).select(
        "event_id", "k", F.col(CORRUPT).alias("corrupt_record"),
        F.array_join(MISSING, ",").alias("missing_fields"))


@query("""
WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, event_id,
                  CASE WHEN event_type = 'error' THEN 'unreadable' WHEN event_type = 'click' AND day(ts) >= 20 THEN 'renamed'
                       WHEN event_type = 'signup' AND day(ts) >= 15 THEN 'text' ELSE 'plain' END AS kind,
                  event_type <> 'error' AND event_id % 2 = 0 AND day(ts) >= 10 AS marked
           FROM events),
f AS (SELECT day, NULL AS field, 'unreadable' AS change, NULL AS found FROM p WHERE kind = 'unreadable'
      UNION ALL SELECT day, 'k', 'gone', NULL FROM p WHERE kind = 'renamed'
      UNION ALL SELECT day, 'kk', 'added', 'BIGINT' FROM p WHERE kind = 'renamed'
      UNION ALL SELECT day, 'k', 'retyped', 'STRING' FROM p WHERE kind = 'text'
      UNION ALL SELECT day, 'src', 'added', 'STRING' FROM p WHERE marked)
SELECT CAST(field AS VARCHAR) AS field, change, CAST(found AS VARCHAR) AS found, min(day) AS first_day, max(day) AS last_day,
       CAST(count(*) AS BIGINT) AS n_rows
FROM f GROUP BY ALL
""")
def payload_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose payloads change over the month: a field more from the tenth, another type from the fifteenth, a
    renamed field from the twentieth, broken text throughout."""
    props, kind, day = F.col("props"), F.col("event_type"), F.dayofmonth("ts")
    text = (F.when((kind == "click") & (day >= 20), F.replace(props, F.lit('"k"'), F.lit('"kk"')))
            .when((kind == "signup") & (day >= 15), F.regexp_replace(props, ": ([0-9]+)", ': "$1"')).otherwise(props))
    marked = F.when((F.col("event_id") % 2 == 0) & (day >= 10), F.replace(text, F.lit("}"), F.lit(', "src": "web"}')))
    whole = F.coalesce(marked, text)
    landed = table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("_load_date"),
        F.when(kind == "error", F.left(whole, F.length(whole) - 1)).otherwise(whole).alias("payload"))
    return drift(shapes(landed, "_load_date"), "k INT")


def raw_status() -> Column:
    """Order status as an untidy source would send it; P becomes something unknown."""
    return (
        F.when(F.col("o_orderstatus") == "F", " settled ")
        .when(F.col("o_orderstatus") == "O", "new")
        .otherwise(F.concat(F.lit("Pending "), F.col("o_orderpriority")))
    )


def raw_currency() -> Column:
    priority = F.col("o_orderpriority")
    return (
        F.when(priority == "1-URGENT", "eur ").when(priority == "2-HIGH", "usd")
        .when(priority == "4-NOT SPECIFIED", "  ").when(priority == "5-LOW", "Gbp")
    )


CURATED_ORDER = (
    Field("orders_id"),
    Field("event_ts", type="timestamp_ntz"),
    Field("status", allowed=STATUSES),
    Field("amount", type="decimal(18,2)"),
    Field("currency", code=True, default="USD"),
    Field("ingested_at", "_ingested_at", type="timestamp_ntz"),
)


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("orders_id"),
        F.col("o_orderdate").cast("string").alias("event_ts"),
        raw_status().alias("status"), F.col("o_totalprice").alias("amount"),
        raw_currency().alias("currency"), ntz(AS_OF).alias("_ingested_at"))


def curated_orders(spark: SparkSession, sf: str) -> DataFrame:
    return conform_rows(raw_orders(spark, sf), CURATED_ORDER)


CURATED_ORDERS_SQL = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS orders_id, o_orderdate AS event_ts,
       CASE o_orderstatus WHEN 'F' THEN 'SETTLED' WHEN 'O' THEN 'NEW' END AS status,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '5-LOW' THEN 'GBP'
            ELSE 'USD' END AS currency,
       TIMESTAMP '{AS_OF}' AS ingested_at
FROM orders
"""


@query(CURATED_ORDERS_SQL)
def conform(spark: SparkSession, sf: str) -> DataFrame:
    return curated_orders(spark, sf)


@query("SELECT n_nationkey AS n_nation_key, n_name, n_regionkey AS n_region_key FROM nation")
def snake_case_rename(spark: SparkSession, sf: str) -> DataFrame:
    foreign = table(spark, sf, "nation").toDF("N-NationKey", "nName", "N REGION KEY")
    return snake_case_columns(foreign)


@query("""
SELECT 'Pending ' || o_orderpriority AS raw_value, count(*) AS n_rows
FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1
""")
def unknown_values(spark: SparkSession, sf: str) -> DataFrame:
    return unknown(raw_orders(spark, sf), "status", STATUSES)


@query("""
WITH k AS (
  SELECT p_partkey,
         list_filter(list_transform(string_split(' ' || replace(p_name, ' ', ' , ') || ',, ', ','),
                                    lambda x: trim(x)), lambda x: x <> '') AS keys
  FROM part)
SELECT p_partkey, CAST(len(keys) AS INTEGER) AS n_keys, array_to_string(keys, ',') AS key_csv
FROM k
""")
def csv_keys(spark: SparkSession, sf: str) -> DataFrame:
    untidy = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(",, "))
    keys = split_keys(untidy)
    return table(spark, sf, "part").select(
        "p_partkey", F.size(keys).alias("n_keys"), join_keys(keys).alias("key_csv"))


@query("""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rn
  FROM events) WHERE rn = 1
""")
def dedupe_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "events"), ["user_id"], "ts", ["event_id"])


LATEST_LINE_SQL = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (
           PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_quantity,
                    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
  FROM lineitem) WHERE rn = 1
"""


@query(LATEST_LINE_SQL)
def dedupe_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate")


# -- the whole way from a topic to a curated table ---------------------------------

LINE_PAYLOAD = ("line_id STRING, event_ts STRING, status STRING, amount DOUBLE, "
                "part_id BIGINT, supplier_id BIGINT")

CURATED_LINE = (
    Field("line_id"),
    Field("event_ts", type="timestamp_ntz"),
    Field("status", allowed=STATUSES),
    Field("amount", type="decimal(18,2)"),
    Field("part_id", type="bigint"),
    Field("supplier_id", type="bigint"),
)


def line_records(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as messages on a topic; repeated line keys are replays."""
    status = (F.when(F.col("l_returnflag") == "A", " active")
              .when(F.col("l_returnflag") == "N", "New").otherwise("returned"))
    message = F.to_json(F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"),
        F.col("l_shipdate").cast("string").alias("event_ts"), status.alias("status"),
        F.col("l_extendedprice").alias("amount"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id")))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").cast("binary").alias("key"),
        message.cast("binary").alias("value"), F.lit("lines").alias("topic"),
        (F.col("l_orderkey") % 8).cast("int").alias("partition"),
        F.col("l_linenumber").cast("bigint").alias("offset"),
        F.col("l_shipdate").alias("timestamp"))


def curated_lines(spark: SparkSession, sf: str) -> DataFrame:
    landed = decode(line_records(spark, sf), ntz(AS_OF))
    parsed = parse(landed, LINE_PAYLOAD).filter(F.col(CORRUPT).isNull())
    return latest(conform_rows(parsed, CURATED_LINE), ["line_id"], "event_ts")


CURATED_LINES_SQL = """
SELECT line_id, event_ts, status, amount, part_id, supplier_id FROM (
  SELECT *, row_number() OVER (
           PARTITION BY line_id ORDER BY event_ts DESC NULLS LAST, status NULLS LAST, amount,
                        part_id, supplier_id) AS rn
  FROM (
    SELECT l_orderkey || '-' || l_linenumber AS line_id, l_shipdate AS event_ts,
           CASE l_returnflag WHEN 'A' THEN 'ACTIVE' WHEN 'N' THEN 'NEW' END AS status,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
           l_partkey AS part_id, l_suppkey AS supplier_id
    FROM lineitem)) WHERE rn = 1
"""


@query(CURATED_LINES_SQL)
def curate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return curated_lines(spark, sf)


@query(f"""
SELECT status, count(*) AS n_rows, CAST(sum(amount) AS DECIMAL(38,2)) AS amount
FROM ({CURATED_LINES_SQL}) GROUP BY status
""")
def curated_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return curated_lines(spark, sf).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("amount").cast("decimal(38,2)").alias("amount"))


@query(CURATED_LINES_SQL)
def curate_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines in three slices, folded in turn; replays of a line lie in different slices."""
    landed = decode(line_records(spark, sf), ntz(AS_OF))
    rows = parse(landed, LINE_PAYLOAD).filter(F.col(CORRUPT).isNull())
    current = None
    for piece in range(3):
        slice_ = conform_rows(rows.filter(F.pmod("part_id", F.lit(3)) == piece), CURATED_LINE)
        arriving = latest(slice_, ["line_id"], "event_ts")
        current = arriving if current is None else upsert_latest(
            current, arriving, ["line_id"], "event_ts", then_latest=())
    return current


@query(f"""
SELECT strftime(ts, '%Y-%m-%d') AS _load_date, count(*) AS n_rows,
       count(*) FILTER (WHERE value < 20) AS n_empty
FROM events WHERE event_id % 10 <> 0 GROUP BY 1
""")
def stream_landing(spark: SparkSession, sf: str) -> DataFrame:
    """Events drained as a topic into a fresh landing folder and read back by load date: rows without
    an offset are dropped in the stream, empty payloads only counted."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-landing-{uuid.uuid4().hex}"
    target = f"parquet:{root}/landed"
    done = streams.land(_topic(spark, sf, "events.parquet", table(spark, sf, "events").schema), "events", root, target)
    counted = _by_load_date(streams.landed(spark, target))
    # What the stream counted while it wrote has to be what is there.
    agrees = F.lit(done.rows_kept) == F.sum("n_rows").over(Window.partitionBy())
    return counted.withColumn("_agrees", F.assert_true(agrees)).filter("_agrees IS NULL").drop("_agrees")


def _topic(spark: SparkSession, folder: str, files: str, schema: T.StructType) -> DataFrame:
    """Files of events, read as a stream of topic records."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    records = events.select(
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.when(F.col("value") < 20, "").otherwise(F.col("props")).cast("binary").alias("value"),
        F.lit("events").alias("topic"), F.lit(0).alias("partition"),
        F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("offset"),
        F.col("ts").alias("timestamp"))
    return decode(records, F.col("timestamp"))


def _by_load_date(landed: DataFrame) -> DataFrame:
    return landed.groupBy(F.col("_load_date").cast("string").alias("_load_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.length("payload") == 0).alias("n_empty"))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS _load_date, count(*) AS n_rows,
       count(*) FILTER (WHERE value < 20) AS n_empty,
       count(*) + count(*) FILTER (WHERE event_id % 3 < 2) AS n_landed
FROM events WHERE event_id % 10 <> 0 GROUP BY 1
""")
def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive in three parts: two drains, a lost checkpoint, and a drain that begins anew and finds the first
    two parts again and the third. The days are compacted. Nothing is lost, and what landed twice is one row once folded."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-restart-{uuid.uuid4().hex}"
    target = f"parquet:{root}/landed"
    events = table(spark, sf, "events")

    def arrives(part: int) -> None:
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{root}/inbox")

    for part, checkpoint in ((0, "first"), (1, "first"), (2, "second")):
        arrives(part)
        streams.land(_topic(spark, f"{root}/inbox", "*.parquet", events.schema), "events", f"{root}/{checkpoint}", target)
    days = streams.landed(spark, target).select("_load_date").distinct().orderBy("_load_date").limit(2).collect()
    for day in days:  # the first two days; the others stay as they landed
        streams.compact(spark, target, day[0])
    streams.sweep(spark, target)
    landed = streams.landed(spark, target)
    folded = _by_load_date(latest(landed, ["kafka_topic", "kafka_partition", "kafka_offset"], "kafka_timestamp"))
    again = landed.groupBy("_load_date").agg(F.count(F.lit(1)).alias("n_landed"))
    return folded.join(again, "_load_date")


# A stream's rules here: an offset, and a payload with something in it.
STRICT = (*streams.DROP, Expectation("payload_not_empty", "length(payload) > 0"))


@query("""
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS _load_date, event_id % 10 = 0 AS no_offset, value < 20 AS empty FROM events)
SELECT _load_date, count(*) FILTER (NOT no_offset AND NOT empty) AS n_kept,
       count(*) FILTER (no_offset OR empty) AS n_refused, count(*) FILTER (no_offset) AS n_no_offset,
       count(*) FILTER (empty) AS n_empty, count(*) FILTER (no_offset AND empty) AS n_both
FROM e GROUP BY 1
""")
def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Events drained in two batches that land in one place and are refused, with all reasons, in another. The record
    that the second batch is done is lost, so it runs again; both places hold it once."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-quarantine-{uuid.uuid4().hex}"
    target = f"parquet:{root}/landed"
    events = table(spark, sf, "events")
    for part in (0, 1, None):
        if part is not None:
            events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/inbox")
        else:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{streams.checkpoint_of(root, 'events')}/commits/1")
            if not done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, False):
                raise FileNotFoundError(done.toString())
        streams.land(_topic(spark, f"{root}/inbox", "*.parquet", events.schema), "events", root, target, STRICT, (),
                     keep_refused=True)
    reason = lambda name: F.array_contains(streams.REASONS, name)
    refused = streams.quarantined(spark, target).groupBy("_load_date").agg(
        F.count(F.lit(1)).alias("n_refused"), F.count_if(reason(STRICT[0].name)).alias("n_no_offset"),
        F.count_if(reason(STRICT[1].name)).alias("n_empty"), F.count_if(F.size(streams.REASONS) == 2).alias("n_both"))
    return (streams.landed(spark, target).groupBy("_load_date").agg(F.count(F.lit(1)).alias("n_kept"))
            .join(refused, "_load_date", "full").fillna(0))


@query("""
WITH m AS (SELECT max(ts) FILTER (event_id % 7 <> 3) - INTERVAL 5 DAYS AS mark FROM events),
e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_id % 7 <> 3 OR ts >= mark AS kept FROM events, m)
SELECT day, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_late, count(*) AS n_distinct
FROM e GROUP BY day
""")
def stream_replays(spark: SparkSession, sf: str) -> DataFrame:
    """Events drained in three parts, the second repeating five days of the first, the third, after a lost checkpoint,
    repeating all and bringing events that came late. Those within five days land once; of those behind them the side
    table holds each, and the new ones are told from replays. Landed and late events are the different ones."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-replays-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")
    once = OnceLanding(spark, f"parquet:{root}/landed", ("event_id",), "ts", timedelta(days=5))
    on_time, day = F.col("event_id") % 7 != 3, F.dayofmonth("ts")
    for number, part in enumerate((on_time & (day <= 15), on_time & (day > 10), None)):
        if part is not None:
            events.filter(part).write.mode("append").parquet(f"{root}/inbox")
        else:
            events.filter(~on_time).write.mode("append").parquet(f"{root}/inbox")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/inbox")
        once.drain(stream, "events", f"{root}/{'first' if number < 2 else 'second'}")
    by_day = lambda rows, name: rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias(name))
    return by_day(once.rows(), "n_kept").join(by_day(once.settled(), "n_late"), "day", "full").fillna(0).withColumn(
        "n_distinct", F.col("n_kept") + F.col("n_late"))


@query("""
WITH k AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 5000000 + l_linenumber * 100 + l_suppkey % 100
                       ELSE l_orderkey * 1000 END AS key FROM lineitem)
SELECT CAST(8 AS BIGINT) AS n_reads, count(*) AS n_rows, min(key) AS min_key, max(key) AS max_key, TRUE AS balanced FROM k
""")
def split_points(spark: SparkSession, sf: str) -> DataFrame:
    """Reads cut by the keys' own quantiles, on a key with a third of all rows in a narrow range: no read has
    more than twice the mean."""
    order = F.col("l_orderkey")
    keys = table(spark, sf, "lineitem").select(
        F.when(order % 3 == 0, 5000000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100)
        .otherwise(order * 1000).cast("long").alias("key"))
    split = points_from(keys, "key", 8)
    reads = keys.groupBy(split.number().alias("read")).agg(
        F.count(F.lit(1)).alias("own"), F.min("key").alias("low"), F.max("key").alias("high"))
    return reads.agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum("own").alias("n_rows"), F.min("low").alias("min_key"),
        F.max("high").alias("max_key"), (F.max("own") <= 2 * F.avg("own")).alias("balanced"))


@query("""
WITH l AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events)
SELECT user_id, ts, event_id, CAST(3 AS BIGINT) AS n_folds FROM l WHERE rn = 1
""")
def fold_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of every user, kept by day and folded in three parts, of which the last holds late ones; only
    days that a part touches are read and written again."""
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    folder = f"{ensure_checkpoint_dir(spark)}/fold-by-day-{uuid.uuid4().hex}"
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    daily = DailyTable(spark, folder, kinds, ("user_id",), "ts")
    late = F.col("event_id") % 7 == 3
    early = F.dayofmonth("ts") <= 20
    for part in (early & ~late, ~early & ~late, late):
        daily.fold(events.filter(part))
    return daily.rows().withColumn("n_folds", F.lit(daily.commits().count()).cast("long"))
