"""Table sync, high-water marks, ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import ntz
from tidemark.operators import sync
from tidemark.queries.catalogue import AS_OF, query, table
from tidemark.sources.jdbc import newer_than

SEEDED = "2023-01-01 00:00:00"
_OWNED = ["source_object", "use_case", "source_system", "is_active"]


def _desired(spark: SparkSession, sf: str) -> DataFrame:
    """What is declared: every part but the largest."""
    return table(spark, sf, "part").filter(F.col("p_size") <= 45).select(
        F.col("p_partkey").alias("source_id"), F.col("p_name").alias("source_object"),
        F.col("p_brand").alias("use_case"), F.col("p_type").alias("source_system"),
        F.lit(True).alias("is_active"))


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored: every part but the smallest, padded, partly renamed or off."""
    small = F.col("p_type") == "SMALL"
    return table(spark, sf, "part").filter(F.col("p_size") >= 4).select(
        F.col("p_partkey").alias("source_id"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("source_object"),
        F.when(small, "Brand#0").otherwise(F.col("p_brand")).alias("use_case"),
        F.col("p_type").alias("source_system"), (F.col("p_type") != "PROMO").alias("is_active"),
        ntz(SEEDED).alias("created_at"), ntz(SEEDED).alias("updated_at"))


_MATCHED = f"""
WITH d AS (SELECT p_partkey AS source_id, p_name AS source_object, p_brand AS use_case,
                  p_type AS source_system, TRUE AS is_active FROM part WHERE p_size <= 45),
e AS (SELECT p_partkey AS source_id, ' ' || p_name || ' ' AS source_object,
             CASE WHEN p_type = 'SMALL' THEN 'Brand#0' ELSE p_brand END AS use_case,
             p_type AS source_system, p_type <> 'PROMO' AS is_active,
             TIMESTAMP '{SEEDED}' AS created_at, TIMESTAMP '{SEEDED}' AS updated_at
      FROM part WHERE p_size >= 4),
j AS (
  SELECT coalesce(e.source_id, d.source_id) AS source_id,
         d.source_object AS d_object, d.use_case AS d_use_case, d.source_system AS d_system,
         d.is_active AS d_active, e.source_object AS e_object, e.use_case AS e_use_case,
         e.source_system AS e_system, e.is_active AS e_active, e.created_at, e.updated_at,
         CASE WHEN e.source_id IS NULL THEN 'insert'
              WHEN d.source_id IS NOT NULL
                   AND (trim(d.source_object) IS DISTINCT FROM trim(e.source_object)
                        OR d.use_case IS DISTINCT FROM e.use_case
                        OR d.source_system IS DISTINCT FROM e.source_system
                        OR d.is_active IS DISTINCT FROM e.is_active) THEN 'update'
              WHEN d.source_id IS NOT NULL THEN 'unchanged'
              WHEN e.is_active THEN 'deactivate' ELSE 'retired' END AS action
  FROM e FULL JOIN d ON e.source_id = d.source_id)
"""


@query(f"{_MATCHED} SELECT source_id, action FROM j")
def sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    return sync.plan(_desired(spark, sf), _existing(spark, sf), "source_id", _OWNED)


@query(f"""{_MATCHED}
SELECT CASE WHEN coalesce(e_system, d_system) = 'LARGE' THEN action ELSE 'out_of_scope' END
         AS action, count(*) AS n_rows
FROM j WHERE coalesce(e_system, d_system) = 'LARGE' OR e_system IS NOT NULL GROUP BY 1
""")
def sync_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """A sync of one subset only: rows of the others are out of its scope."""
    return sync.summary(sync.plan(_desired(spark, sf), _existing(spark, sf), "source_id", _OWNED,
                                  scope="source_system = 'LARGE'"))


@query(f"""{_MATCHED}
SELECT source_id,
       CASE WHEN action IN ('insert', 'update') THEN d_object ELSE e_object END AS source_object,
       CASE WHEN action IN ('insert', 'update') THEN d_use_case ELSE e_use_case END AS use_case,
       CASE WHEN action IN ('insert', 'update') THEN d_system ELSE e_system END AS source_system,
       CASE WHEN action IN ('insert', 'update') THEN d_active
            WHEN action = 'deactivate' THEN FALSE ELSE e_active END AS is_active,
       coalesce(created_at, TIMESTAMP '{AS_OF}') AS created_at,
       CASE WHEN action IN ('insert', 'update', 'deactivate') THEN TIMESTAMP '{AS_OF}'
            ELSE updated_at END AS updated_at
FROM j
""")
def sync_apply(spark: SparkSession, sf: str) -> DataFrame:
    return sync.apply(_desired(spark, sf), _existing(spark, sf), "source_id", _OWNED, ntz(AS_OF))


# Sources are the order priorities. Urgent orders were never loaded, low ones are
# already loaded further than this batch reaches.
_LOADED, _REACHED = "1998-01-01", "1999-01-01"


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    priority, dated = F.col("o_orderpriority"), F.col("o_orderdate")
    loaded = orders.filter((priority != "1-URGENT")
                           & ((dated < ntz(_LOADED)) | (priority == "5-LOW")))
    return (sync.batch_marks(loaded, priority, "o_orderdate", "o_orderkey")
            .withColumn("updated_at", ntz(SEEDED)))


_MARKS_SQL = f"""
WITH m AS (SELECT o_orderpriority AS source_id, max(o_orderdate) AS ts_value,
                  max(o_orderkey) AS long_value, TIMESTAMP '{SEEDED}' AS updated_at
           FROM orders WHERE o_orderpriority <> '1-URGENT'
             AND (o_orderdate < TIMESTAMP '{_LOADED}' OR o_orderpriority = '5-LOW') GROUP BY 1)
"""


@query(f"""{_MARKS_SQL},
b AS (SELECT o_orderpriority AS source_id, max(o_orderdate) AS ts_value,
             max(o_orderkey) AS long_value
      FROM orders WHERE o_orderdate < TIMESTAMP '{_REACHED}' GROUP BY 1)
SELECT coalesce(m.source_id, b.source_id) AS source_id,
       greatest(m.ts_value, b.ts_value) AS ts_value,
       greatest(m.long_value, b.long_value) AS long_value,
       CAST(NULL AS DECIMAL(38,10)) AS exact_value, CAST(NULL AS DOUBLE) AS real_value,
       CASE WHEN m.source_id IS NULL OR b.ts_value > m.ts_value OR b.long_value > m.long_value
            THEN TIMESTAMP '{AS_OF}' ELSE m.updated_at END AS updated_at
FROM m FULL JOIN b ON m.source_id = b.source_id
""")
def watermark_advance(spark: SparkSession, sf: str) -> DataFrame:
    batch = table(spark, sf, "orders").filter(F.col("o_orderdate") < ntz(_REACHED))
    newest = sync.batch_marks(batch, F.col("o_orderpriority"), "o_orderdate", "o_orderkey")
    return sync.advance(_marks(spark, sf), newest, ntz(AS_OF))


@query(f"""{_MARKS_SQL}
SELECT source_id, CASE WHEN source_id = '2-HIGH' THEN TIMESTAMP '1997-01-01'
                       ELSE ts_value END AS ts_value, long_value,
       CAST(NULL AS DECIMAL(38,10)) AS exact_value, CAST(NULL AS DOUBLE) AS real_value,
       CASE WHEN source_id = '2-HIGH' THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
FROM m
""")
def watermark_reset(spark: SparkSession, sf: str) -> DataFrame:
    return sync.reset(_marks(spark, sf), "2-HIGH", datetime(1997, 1, 1), ntz(AS_OF))


@query(r"""
WITH available AS (SELECT doc_id, md5(text) AS checksum FROM documents),
applied AS (SELECT doc_id, md5(replace(text, chr(10), ' ')) AS checksum
            FROM documents WHERE n_chars < 2000)
SELECT v.doc_id, v.checksum,
       CASE WHEN p.doc_id IS NULL THEN 'pending' WHEN p.checksum <> v.checksum THEN 'drifted'
            ELSE 'applied' END AS state
FROM available v LEFT JOIN applied p ON v.doc_id = p.doc_id
""")
def change_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Shorter documents were applied before, with line breaks flattened in some."""
    documents = table(spark, sf, "documents")
    flattened = F.md5(F.replace("text", F.lit("\n"), F.lit(" ")))
    available = documents.select("doc_id", F.md5("text").alias("checksum"))
    applied = (documents.filter(F.col("n_chars") < 2000)
               .select("doc_id", flattened.alias("checksum")))
    return sync.ledger(available, applied, "doc_id")


@query("""
WITH o AS (SELECT *, o_totalprice / 7 AS v FROM orders),
m AS (SELECT max(v) AS real_mark FROM o WHERE v < (SELECT max(v) FROM o))
SELECT max(CAST(o_orderdate AS DATE))::TIMESTAMP AS date_mark, max(o_orderkey) AS number_mark,
       CAST(max(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(38,10)) AS exact_mark,
       max(real_mark) AS real_mark, count(*) FILTER (WHERE v > real_mark) AS n_following
FROM o, m
""")
def watermark_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Marks over a DATE, a whole number, a decimal and a DOUBLE, each of its own kind and exact; and the rows that
    follow a DOUBLE mark set just below the highest."""
    orders = table(spark, sf, "orders").withColumns({
        "ordered": F.col("o_orderdate").cast("date"), "price": F.col("o_totalprice").cast("decimal(15,2)"),
        "v": F.col("o_totalprice") / 7})
    marks = {"date_mark": "ordered", "number_mark": "o_orderkey", "exact_mark": "price"}
    value = lambda df, c: sync.mark_value(c, df.schema[c].dataType)
    highest = orders.agg(value(orders, "v")).first()[0]
    seen = orders.filter(F.col("v") < highest)
    mark = seen.agg(value(seen, "v")).first()[0]
    following = newer_than(orders.select("v"), "v", mark).count()
    return orders.agg(*[value(orders, c).alias(name) for name, c in marks.items()],
                      F.lit(mark).alias("real_mark"), F.lit(following).cast("long").alias("n_following"))
