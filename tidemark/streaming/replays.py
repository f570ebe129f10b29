"""Drain a stream so that a record delivered twice lands once, with state bounded by event time.

The mark of a batch is the greatest event time of all earlier committed batches less ``delay``. A record at or above
it is timely: it lands unless a timely record of the same keys has landed, which the keys kept as state tell. Keys behind
the mark are state no longer, so the state holds ``delay`` of event time however long the stream runs. A record behind the
mark cannot be judged by it; Spark's own operator drops such records without a trace, here they land in a table of their
own, with all records whose keys or event time are NULL. ``settled`` says later which of these are new.

Records, state and commit record of a batch are written under the batch's name, so a batch that runs again replaces itself,
and a query that starts over with a new checkpoint goes on from the marks and state that the old one committed. The
date that partitions the landed records is that of their event, in UTC or whatever zone the session keeps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import timedelta
from functools import reduce
from operator import and_
from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedupe import dedupe_latest
from tidemark.plans import tables
from tidemark.streaming.landing import BATCH, LOAD_DATE, Sink, checkpoint_of, commits, landed

NO_DATE = "none"
LATEST = "latest_us"  # greatest event time of a batch's timely records, kept among the counts of its commit record


@dataclass(frozen=True)
class Once:
    """What one drain did with the records that it read."""

    rows_read: int
    kept: int
    replayed: int
    late: int


@dataclass(frozen=True)
class OnceLanding:
    """``keys`` name a record, ``at`` is its event time; a replay carries both unchanged."""

    spark: SparkSession
    target: str
    keys: tuple[str, ...]
    at: str
    delay: timedelta

    @property
    def _sink(self) -> Sink:
        return Sink(self.spark, self.target)

    def _beside(self, what: str) -> Sink:
        sink = self._sink
        return replace(sink, target=f"parquet:{sink.folder}/_{what}" if sink.folder else f"{self.target}__{what}")

    def _micros(self) -> Column:
        return F.unix_micros(F.col(self.at).cast("timestamp"))

    def _dated(self, rows: DataFrame, name: str) -> DataFrame:
        day = F.coalesce(F.date_format(self.at, "yyyy-MM-dd"), F.lit(NO_DATE))
        return rows.withColumns({LOAD_DATE: day, BATCH: F.lit(name)})

    def _before(self, name: str) -> dict[str, int]:
        """The greatest event time of every other committed batch that had timely records; one number a batch."""
        latest = F.col("counts")[LATEST]
        rows = commits(self.spark, self.target).where(latest.isNotNull() & (F.col(BATCH) != name))
        return {row[0]: row[1] for row in rows.select(BATCH, latest).collect()}

    def _mark(self, latest: dict[str, int]) -> int | None:
        return max(latest.values()) - self.delay // timedelta(microseconds=1) if latest else None

    def _timely(self, mark: int | None) -> Column:
        named = reduce(and_, [F.col(c).isNotNull() for c in (*self.keys, self.at)])
        return named if mark is None else named & (self._micros() >= mark)

    def _seen(self, fields: T.StructType, latest: dict[str, int], mark: int | None) -> DataFrame | None:
        """(keys, event time) of the landed records at or above the mark; batches wholly behind it are not opened."""
        alive = [name for name, at in latest.items() if at >= mark] if latest else []
        if not alive:
            return None
        sink = self._beside("seen")
        if sink.folder:
            kinds = T.StructType([*[fields[c] for c in (*self.keys, self.at)], T.StructField(BATCH, T.StringType())])
            stored = self.spark.read.schema(kinds).parquet(sink.folder)
        else:
            stored = sink.read(sink.target)
        return stored.where(F.col(BATCH).isin(alive) & (self._micros() >= mark)).select(*self.keys)

    def _keep(self, batch: DataFrame, name: str, first_of_run: bool) -> Once:
        sink, late, seen = self._sink, self._beside("late"), self._beside("seen")
        if first_of_run:  # it may have been begun before, from records that had other dates
            for side in (sink, late):
                if side.exists(side.folder or side.target):
                    side.remove(lambda values: values[BATCH] == name)
        latest = self._before(name)
        mark = self._mark(latest)
        timely = F.coalesce(self._timely(mark), F.lit(False))
        counted = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(timely).alias("timely"),
                            F.max(F.when(timely, self._micros())).alias("latest")).first()
        n_late, kept = counted["rows"] - counted["timely"], 0
        counts = {"rows": counted["rows"], "late": n_late}
        if counted["timely"]:
            fresh = dedupe_latest(batch.where(timely), list(self.keys), self.at)
            known = self._seen(batch.schema, latest, mark)
            if known is not None:
                fresh = fresh.join(known, list(self.keys), "left_anti").select(*batch.columns)
            sink.replace(self._dated(fresh, name), sink.folder or sink.target, LOAD_DATE, BATCH)
            kinds = T.StructType([*batch.schema.fields, T.StructField(LOAD_DATE, T.StringType()),
                                  T.StructField(BATCH, T.StringType())])
            stored = self.spark.read.schema(kinds).parquet(sink.folder) if sink.folder else sink.read(sink.target)
            own = stored.where(F.col(BATCH) == name).select(*self.keys, self.at, BATCH)
            seen.replace(own, seen.folder or seen.target, BATCH)
            kept = own.count()
            counts[LATEST] = counted["latest"]
        if n_late:
            late.replace(self._dated(batch.where(~timely), name), late.folder or late.target, LOAD_DATE, BATCH)
        done = Once(counted["rows"], kept, counted["timely"] - kept, n_late)
        sink.commit(name, {**counts, "kept": done.kept, "replayed": done.replayed})
        return done

    def drain(self, stream: DataFrame, source_id: str, root: str) -> Once:
        """Land everything that is available now, batch by batch, then stop."""
        if not self._sink.folder:
            tables.ensure_database(self.spark, self.target)
        started, identity, ran = Event(), [], []

        def keep(batch: DataFrame, number: int) -> None:
            started.wait()
            here = replace(self, spark=batch.sparkSession)
            ran.append(here._keep(batch, f"{identity[0]}_{number}", not ran))

        query = (stream.writeStream.foreachBatch(keep).queryName(f"once_{source_id}")
                 .option("checkpointLocation", checkpoint_of(root, source_id)).trigger(availableNow=True).start())
        identity.append(str(query.id))
        started.set()
        query.awaitTermination()
        return Once(*[sum(getattr(one, f) for one in ran) for f in ("rows_read", "kept", "replayed", "late")])

    def rows(self) -> DataFrame:
        """The landed records, each once."""
        return landed(self.spark, self.target)

    def late(self) -> DataFrame | None:
        """The records of committed batches that came behind the mark or cannot be named, as often as they came; or None."""
        sink, beside = self._sink, self._beside("late")
        where = beside.folder or beside.target
        if not sink.exists(sink.records) or not beside.exists(where):
            return None
        rows = beside.read(where)
        return rows.join(sink.read(sink.records).select(BATCH), BATCH, "left_semi").select(*rows.columns)

    def settled(self) -> DataFrame | None:
        """The late records that are no replay of a landed one, one per key; those without a key or event time are not
        among them. Landed records are read for the dates that late ones name, one row per date being listed."""
        late = self.late()
        if late is None:
            return None
        named = late.where(self._timely(None))
        dates = [row[0] for row in named.select(LOAD_DATE).distinct().collect()]
        known = self.rows().where(F.col(LOAD_DATE).isin(dates)).select(*self.keys)
        first = dedupe_latest(named.drop(BATCH), list(self.keys), self.at)
        return first.join(known, list(self.keys), "left_anti").select(*first.columns)

    def sweep(self) -> int:
        """Drop the state of batches wholly behind the mark; returns how many batches keep some."""
        latest = self._before("")
        mark = self._mark(latest)
        dead = {name for name, at in latest.items() if at < mark} if latest else set()
        sink = self._beside("seen")
        if dead and sink.folder:
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            files = path(sink.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for name in dead:
                files.delete(path(f"{sink.folder}/{BATCH}={name}"), True)
        elif dead:
            tables.drop_partitions(self.spark, sink.target, lambda values: values[BATCH] in dead)
        return len(latest) - len(dead)
