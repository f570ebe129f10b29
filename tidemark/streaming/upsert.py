"""Fold a stream into a latest-wins table."""

from __future__ import annotations

from collections.abc import Sequence
from threading import Event
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedupe import dedupe_latest
from tidemark.operators.dims import upsert_latest
from tidemark.plans import tables

BATCH = "_batch"


def collect_changes(stream: DataFrame, keys: Sequence[str], order_by: str, changes: str,
                    checkpoint: str, name: str = "changes") -> int:
    """Drain a stream into the table ``changes``: one partition per micro-batch, one row
    per key and batch.

    A partition is named after the query and the batch. A query that starts over with a new
    checkpoint is another query, so its first batch takes nobody's place; a batch that is
    run again overwrites its own partition. Returns the number of micro-batches that ran.
    """
    numbered = T.StructType([*stream.schema.fields, T.StructField(BATCH, T.StringType())])
    tables.create_partitioned(stream.sparkSession, changes, numbered, BATCH)
    started, ran, identity = Event(), set(), []

    def keep(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        latest = dedupe_latest(batch, keys, order_by)
        tables.replace_partitions(
            latest.withColumn(BATCH, F.lit(f"{identity[0]}_{batch_id}")), changes, BATCH)
        ran.add(batch_id)

    query = (stream.writeStream.foreachBatch(keep).queryName(name)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    identity.append(str(query.id))
    started.set()
    query.awaitTermination()
    # The batches were written by the stream's own session; drop this one's file list.
    stream.sparkSession.catalog.refreshTable(changes)
    return len(ran)


def fold(spark: SparkSession, changes: str, table: str, keys: Sequence[str], order_by: str,
         **layout: Any) -> tables.Published | None:
    """Merge all pending batches into ``table``; None when there are none.

    The table is rewritten once per drain, not once per micro-batch. Folding is latest-wins in one
    total order, so a batch that is folded a second time, because a crash kept it pending or
    because it was replayed, changes nothing. What was read is dropped once the table shows it.
    """
    # One row per micro-batch, never the rows in it.
    names = [row[0].partition("=")[2] for row in spark.sql(f"SHOW PARTITIONS {changes}").collect()]
    if not names:
        return None
    pending = spark.table(changes).filter(F.col(BATCH).isin(names)).drop(BATCH)
    latest = dedupe_latest(pending, keys, order_by)
    if spark.catalog.tableExists(table):
        latest = upsert_latest(spark.table(table), latest, keys, order_by, then_latest=())
    done = tables.publish(latest, table, **layout)
    tables.drop_partitions(spark, changes, lambda values: values[BATCH] in names)
    return done
