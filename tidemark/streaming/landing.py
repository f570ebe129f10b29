"""Drain a stream into a landing table, checking rows on the way, under commit records of our own.

Every micro-batch is written into partitions named after the query and the batch, and is recorded as committed once
all of it is there. A batch that runs again replaces its own partitions; one that tore is seen by nobody who reads through
``landed``; a query that starts over with a new checkpoint is another query, so its batches take nobody's place and nothing
that the new offsets pass over is lost. What lands twice that way is removed where replays are: in curation.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from threading import Event

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import Expectation, not_null
from tidemark.plans import tables
from tidemark.sources.refs import open_ref
from tidemark.sources.registry import SourceSpec

# A landed row must be traceable to its offset; an empty payload is only worth a warning.
DROP = (not_null("kafka_offset"),)
WARN = (Expectation("payload_not_empty", "payload IS NOT NULL AND length(payload) > 0", "warn"),)


LOAD_DATE, BATCH, REASONS = "_load_date", "_batch", "_reasons"
COMMITS = ("rows BIGINT, counts MAP<STRING, BIGINT>, of_date STRING, replaces ARRAY<STRING>, "
           "committed_at TIMESTAMP, _batch STRING")


@dataclass(frozen=True)
class Drained:
    """What one drain of a source did, or why it failed."""

    source_id: str
    rows_read: int
    counts: dict[str, int]
    error: str | None = None

    @property
    def rows_kept(self) -> int:
        return self.counts.get("rows", 0) - self.counts.get("dropped", 0)


def checkpoint_of(root: str, source_id: str) -> str:
    """One checkpoint per source: adding a source disturbs no other."""
    return f"{root}/_checkpoints/{source_id}"


def expect(drop: Sequence[Expectation] = DROP, warn: Sequence[Expectation] = WARN) -> tuple:
    """The rows that no ``drop`` rule refuses, as a condition, and the counts of all rules."""
    broken = F.lit(False)
    for rule in drop:
        broken = broken | rule.violated()
    return ~broken, [F.count(F.lit(1)).alias("rows"), F.count_if(broken).alias("dropped"),
                     *[F.count_if(rule.violated()).alias(rule.name) for rule in (*drop, *warn)]]


def refused_rows(rows: DataFrame, drop: Sequence[Expectation] = DROP) -> DataFrame:
    """The rows that a ``drop`` rule refuses, each with the names of all the rules that refuse it."""
    reasons = F.array_compact(F.array(*[F.when(rule.violated(), rule.name) for rule in drop]))
    return rows.withColumn(REASONS, reasons).where(F.size(REASONS) > 0)


def dated(stream: DataFrame) -> DataFrame:
    """Add the load date, by which landing is partitioned and curation prunes."""
    return stream.withColumn(LOAD_DATE, F.date_format("_ingested_at", "yyyy-MM-dd"))


@dataclass(frozen=True)
class Sink:
    """A landing table, or a folder (``parquet:/path``), and the commit records beside it."""

    spark: SparkSession
    target: str

    @property
    def folder(self) -> str | None:
        scheme, _, path = self.target.partition(":")
        return path if scheme == "parquet" and path else None

    @property
    def records(self) -> str:
        return f"{self.folder}/_commits" if self.folder else f"{self.target}__commits"

    @property
    def refused(self) -> Sink:
        """Where the refused rows of the same batches lie; they count by the same commit records."""
        return replace(self, target=f"parquet:{self.folder}/_refused" if self.folder else f"{self.target}__refused")

    def exists(self, name: str) -> bool:
        if not self.folder:
            return self.spark.catalog.tableExists(name)
        return self._files(name).exists(self._path(name))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> DataFrame:
        if not self.folder:
            self.spark.catalog.refreshTable(name)
            return self.spark.table(name)
        found = self.spark.read.parquet(name)  # partition values come back as whatever they look like
        return found.withColumns({c: F.col(c).cast("string") for c in (LOAD_DATE, BATCH) if c in found.columns})

    def replace(self, df: DataFrame, name: str, *by: str) -> None:
        """Write rows so that the partitions they fall into hold nothing else."""
        if not self.folder:
            tables.replace_partitions(df, name, *by)
        else:
            (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*by).parquet(name))

    def remove(self, gone: Callable[[dict[str, str]], bool]) -> int:
        """Drop whole partitions of the data; one row per partition is listed."""
        if not self.folder:
            if not self.exists(self.target):
                return 0
            return tables.drop_partitions(self.spark, self.target, gone)
        files, dropped = self._files(self.folder), 0
        for status in files.globStatus(self._path(f"{self.folder}/{LOAD_DATE}=*/{BATCH}=*")) or []:
            path = status.getPath()
            values = dict(part.split("=", 1) for part in (path.getParent().getName(), path.getName()))
            if gone(values):
                files.delete(path, True)
                dropped += 1
        return dropped

    def commit(self, name: str, counts: dict[str, int], of_date: str | None = None,
               replaces: Sequence[str] = ()) -> None:
        """The last act of a batch: from here on readers see it."""
        schema = T._parse_datatype_string(COMMITS)
        record = self.spark.createDataFrame(
            [(counts.get("rows", 0), counts, of_date, list(replaces), None, name)], schema)
        self.replace(record.withColumn("committed_at", F.current_timestamp()), self.records, BATCH)


def commits(spark: SparkSession, target: str) -> DataFrame:
    """One row per committed batch: rows read, all counts, and what a compaction replaces."""
    sink = Sink(spark, target)
    if not sink.exists(sink.records):
        return spark.createDataFrame([], T._parse_datatype_string(COMMITS))
    return sink.read(sink.records)


def landed(spark: SparkSession, target: str) -> DataFrame:
    """The rows of committed batches, each once: what a compaction has rewritten is read in its place.

    Tables that no stream has committed to are read as they are. Conditions fall on partition columns only, so
    what is not to be read is not opened.
    """
    sink = Sink(spark, target)
    if (":" in target and not sink.folder) or not sink.exists(sink.records):
        return open_ref(spark, target)
    known = sink.read(sink.records)
    replaced = known.where(F.size("replaces") > 0).select(
        F.col("of_date").alias("its_date"), F.explode("replaces").alias("its_batch"))
    rows = sink.read(sink.folder or target)
    return (rows.join(known.select(BATCH), BATCH, "left_semi")
            .join(replaced, (F.col(LOAD_DATE) == F.col("its_date")) & (F.col(BATCH) == F.col("its_batch")), "left_anti")
            .select(*rows.columns))


def quarantined(spark: SparkSession, target: str) -> DataFrame | None:
    """The refused rows of committed batches with their reasons, or None while there are none.

    They count by the commit records of the target, so both sides of a batch are seen at once or not at all.
    """
    sink, refused = Sink(spark, target), Sink(spark, target).refused
    where = refused.folder or refused.target
    if not sink.exists(sink.records) or not refused.exists(where):
        return None
    rows = refused.read(where)
    return rows.join(sink.read(sink.records).select(BATCH), BATCH, "left_semi").select(*rows.columns)


def _drain(stream: DataFrame, source_id: str, root: str, target: str,
           drop: Sequence[Expectation], warn: Sequence[Expectation], keep_refused: bool = False) -> Drained:
    """Append everything available now, batch by batch, then stop."""
    passes, measures = expect(drop, warn)
    sums: Counter = Counter()
    started, identity, ran = Event(), [], []
    spark = stream.sparkSession
    if ":" not in target:
        tables.ensure_database(spark, target)

    def keep(batch: DataFrame, number: int) -> None:
        started.wait()
        name = f"{identity[0]}_{number}"
        sink = Sink(batch.sparkSession, target)
        if not ran:  # only a run's first batch can have been begun before; its rows may have had other dates
            for side in (sink, sink.refused) if keep_refused else (sink,):
                if side.exists(side.folder or side.target):
                    side.remove(lambda values: values[BATCH] == name)
        seen = Observation()
        rows = dated(batch.observe(seen, *measures).where(passes)).withColumn(BATCH, F.lit(name))
        sink.replace(rows, sink.folder or target, LOAD_DATE, BATCH)
        counts = {k: int(v) for k, v in seen.get.items()}
        if keep_refused and counts["dropped"]:  # most batches have none and are read once
            refused = dated(refused_rows(batch, drop)).withColumn(BATCH, F.lit(name))
            sink.refused.replace(refused, sink.refused.folder or sink.refused.target, LOAD_DATE, BATCH)
        sink.commit(name, counts)
        sums.update(counts)
        ran.append(number)

    query = (stream.writeStream.foreachBatch(keep).queryName(f"landing_{source_id}")
             .option("checkpointLocation", checkpoint_of(root, source_id))
             .trigger(availableNow=True).start())
    identity.append(str(query.id))
    started.set()
    query.awaitTermination()
    return Drained(source_id, sums["rows"], dict(sums))


def land(stream: DataFrame, source_id: str, root: str, target: str,
         drop: Sequence[Expectation] = DROP, warn: Sequence[Expectation] = WARN,
         keep_refused: bool = False) -> Drained:
    """Check, append and drain one source; ``keep_refused`` keeps what the rules drop, see ``quarantined``."""
    done = _drain(stream, source_id, root, target, drop, warn, keep_refused)
    _refresh(stream.sparkSession, target)
    return done


def _refresh(spark: SparkSession, target: str) -> None:
    """Let this session see the files that its stream has added to a table."""
    if ":" not in target and spark.catalog.tableExists(target):
        spark.catalog.refreshTable(target)


def compact(spark: SparkSession, target: str, load_date: str) -> int:
    """Write the batches of one load date again as files of the size that adaptive execution aims at
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``); returns how many batches were joined.

    The new partition is shown by its commit record, which names the batches that it replaces for that date; until
    then, and if this fails, readers see the old ones. These stay for readers under way until ``sweep``.
    """
    sink = Sink(spark, target)
    day = landed(spark, target).where(F.col(LOAD_DATE) == load_date)
    replaces = [row[0] for row in day.select(BATCH).distinct().collect()]  # a row per batch of a day
    if len(replaces) < 2:
        return 0
    name = f"compact_{uuid.uuid4().hex}"
    seen = Observation()
    rows = day.hint("rebalance").observe(seen, F.count(F.lit(1)).alias("rows")).withColumn(BATCH, F.lit(name))
    sink.replace(rows, sink.folder or target, LOAD_DATE, BATCH)
    sink.commit(name, {"rows": int(seen.get["rows"])}, load_date, replaces)
    _refresh(spark, target)
    return len(replaces)


def sweep(spark: SparkSession, target: str) -> int:
    """Drop the partitions that compactions have replaced, once no reader needs them."""
    replaced = {(row["of_date"], name) for row in commits(spark, target).where(F.size("replaces") > 0).collect()
                for name in row["replaces"]}
    dropped = Sink(spark, target).remove(lambda values: (values[LOAD_DATE], values[BATCH]) in replaced)
    _refresh(spark, target)
    return dropped


def land_topics(spark: SparkSession, specs: Sequence[SourceSpec],
                open_stream: Callable[[SourceSpec], DataFrame], root: str,
                target_of: Callable[[SourceSpec], str],
                drop: Sequence[Expectation] = DROP,
                warn: Sequence[Expectation] = WARN, at_once: int = 4,
                keep_refused: bool = False) -> list[Drained]:
    """One query and one checkpoint per registered topic, a bounded number running at once.

    The next topic starts when any has finished. A failing one is reported with its error;
    the others land and keep their counts.
    """
    def one(spec: SourceSpec) -> Drained:
        try:
            return _drain(open_stream(spec), spec.source_id, root, target_of(spec), drop, warn, keep_refused)
        except Exception as error:
            return Drained(spec.source_id, 0, {}, f"{type(error).__name__}: {error}")

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        done = list(pool.map(one, specs))
    for spec, drained in zip(specs, done):
        if not drained.error:
            _refresh(spark, target_of(spec))
    return done
