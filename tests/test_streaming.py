from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quality import Expectation
from tidemark.sources.files import stream_files
from tidemark.sources.kafka import decode_envelope
from tidemark.sources.registry import SourceSpec
from tidemark.streaming import landing, upsert

RECORDS = ("key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, "
           "timestamp TIMESTAMP")
AT = datetime(2024, 1, 1)


def deliver(spark, folder, rows):
    """Drop one file of (key, value, offset) records into the folder."""
    df = spark.createDataFrame(
        [(k.encode(), None if v is None else v.encode(), "t", 0, o, AT) for k, v, o in rows],
        RECORDS)
    df.coalesce(1).write.mode("append").parquet(str(folder))


def topic(spark, folder, max_files=1):
    records = stream_files(spark, str(folder), "parquet", RECORDS, max_files)
    return decode_envelope(records, F.lit(AT))


def test_landing_drops_warns_and_resumes(spark, tmp_path):
    inbox, out = tmp_path / "in", "land_resumes.t"
    deliver(spark, inbox, [("a", "{}", 1), ("b", "", 2), ("c", None, 3)])
    deliver(spark, inbox, [("d", "{}", None), ("e", "{}", 4)])
    done = landing.land(topic(spark, inbox), "s1", str(tmp_path), out)
    assert done.counts == {"rows": 5, "dropped": 1, "kafka_offset_not_null": 1,
                           "payload_not_empty": 2}
    assert done.rows_kept == 4 == spark.table(out).count()

    again = landing.land(topic(spark, inbox), "s1", str(tmp_path), out)
    assert again.rows_read == 0 and spark.table(out).count() == 4

    deliver(spark, inbox, [("f", "{}", 5)])
    more = landing.land(topic(spark, inbox), "s1", str(tmp_path), out)
    assert (more.rows_read, spark.table(out).count()) == (1, 5)


def test_a_landed_table_is_pruned_by_load_date(spark, tmp_path):
    deliver(spark, tmp_path / "in", [("a", "{}", 1)])
    landing.land(topic(spark, tmp_path / "in"), "s1", str(tmp_path), "land_pruned.t")
    read = spark.table("land_pruned.t").filter(F.col("_load_date") >= "2024-01-02")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_load_date" in plan and read.count() == 0
    assert spark.table("land_pruned.t").filter(F.col("_load_date") == "2024-01-01").count() == 1


def test_one_query_and_checkpoint_per_topic(spark, tmp_path):
    specs = [SourceSpec(f"k{i}", "us1", "kafka", f"topic{i}", f"t{i}", "cdc_stream")
             for i in range(4)]
    for i, spec in enumerate(specs):
        deliver(spark, tmp_path / spec.source_object, [("a", "{}", n) for n in range(i + 1)])

    def open_stream(spec):
        if spec.source_id == "k1":
            raise OSError("no such topic")
        return topic(spark, tmp_path / spec.source_object)

    done = landing.land_topics(spark, specs, open_stream, str(tmp_path),
                               lambda s: f"land_topics.{s.target_table}", at_once=2)
    assert [(d.source_id, d.rows_kept, d.error) for d in done] == [
        ("k0", 1, None), ("k1", 0, "OSError: no such topic"), ("k2", 3, None), ("k3", 4, None)]
    assert {p.name for p in (tmp_path / "_checkpoints").iterdir()} == {"k0", "k2", "k3"}
    assert spark.table("land_topics.t3").count() == 4


def test_late_rows_land_and_counts_do_not_depend_on_reports_kept(spark, tmp_path):
    inbox = tmp_path / "in"
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    for offset in range(6):  # one micro-batch each; the last one is older than all before it
        deliver(spark, inbox, [(f"k{offset}", "{}", 10 - offset)])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        done = landing.land(topic(spark, inbox), "s1", str(tmp_path), "land_late.t")
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert done.rows_read == done.rows_kept == 6 == spark.table("land_late.t").count()


@pytest.mark.parametrize("kind", ["table", "folder"])
def test_a_new_checkpoint_loses_no_row(spark, tmp_path, kind):
    inbox = tmp_path / "in"
    target = f"land_reset_{kind}.t" if kind == "table" else f"parquet:{tmp_path}/out"

    def offsets():
        return sorted(r.kafka_offset for r in landing.landed(spark, target).collect())

    deliver(spark, inbox, [("a", "{}", 1), ("b", "{}", 2), ("c", "{}", 3)])
    landing.land(topic(spark, inbox), "s1", str(tmp_path / "one"), target)
    deliver(spark, inbox, [("d", "{}", 4), ("e", "{}", 5)])
    done = landing.land(topic(spark, inbox), "s1", str(tmp_path / "two"), target)
    assert done.rows_read == 5 and offsets() == [1, 1, 2, 2, 3, 3, 4, 5]
    deliver(spark, inbox, [("f", "{}", 6)])
    landing.land(topic(spark, inbox), "s1", str(tmp_path / "two"), target)
    assert sorted(set(offsets())) == [1, 2, 3, 4, 5, 6] and offsets()[-1] == 6
    # another source into the same target keeps its first batches
    deliver(spark, tmp_path / "other", [("x", "{}", 70)])
    landing.land(topic(spark, tmp_path / "other"), "s2", str(tmp_path / "one"), target)
    assert offsets()[-1] == 70
    assert landing.commits(spark, target).count() == 5


def test_a_torn_batch_is_not_seen_and_replaced_by_its_rerun(spark, tmp_path, monkeypatch):
    inbox, target = tmp_path / "in", "land_torn.t"
    deliver(spark, inbox, [("a", "{}", 1)])
    landing.land(topic(spark, inbox), "s1", str(tmp_path), target)
    deliver(spark, inbox, [("b", "{}", 2)])
    commit = landing.Sink.commit

    def lost(*_):
        raise OSError("the driver is gone")

    monkeypatch.setattr(landing.Sink, "commit", lost)
    with pytest.raises(Exception, match="the driver is gone"):
        landing.land(topic(spark, inbox), "s1", str(tmp_path), target)
    assert spark.table(target).count() == 2 and landing.landed(spark, target).count() == 1
    monkeypatch.setattr(landing.Sink, "commit", commit)
    # the rerun gives its rows another load date; what the torn run left under the old one goes
    records = stream_files(spark, str(inbox), "parquet", RECORDS, 1)
    landing.land(decode_envelope(records, F.lit(datetime(2024, 1, 2))), "s1", str(tmp_path), target)
    rows = sorted((r.kafka_offset, str(r._load_date)) for r in landing.landed(spark, target).collect())
    assert rows == [(1, "2024-01-01"), (2, "2024-01-02")] and spark.table(target).count() == 2


@pytest.mark.parametrize("kind", ["table", "folder"])
def test_compaction_joins_a_days_batches(spark, tmp_path, kind):
    inbox = tmp_path / "in"
    target = "land_compact.t" if kind == "table" else f"parquet:{tmp_path}/out"
    for offset in range(5):
        deliver(spark, inbox, [(f"k{offset}", "{}", offset)])
    landing.land(topic(spark, inbox), "s1", str(tmp_path), target)
    before = sorted((r.kafka_offset, r.payload) for r in landing.landed(spark, target).collect())
    reader = landing.landed(spark, target)
    assert landing.compact(spark, target, "2024-01-01") == 5
    now = landing.landed(spark, target)
    assert sorted((r.kafka_offset, r.payload) for r in now.collect()) == before
    assert now.select("_batch").distinct().count() == 1
    stored = landing.Sink(spark, target).read(target if kind == "table" else f"{tmp_path}/out")
    files = [f for f in stored.inputFiles() if "_batch=compact" in f]
    assert len(files) == 1 and len(stored.inputFiles()) == 6
    assert reader.count() == 5  # one that began before
    assert landing.sweep(spark, target) == 5 and landing.landed(spark, target).count() == 5
    assert landing.compact(spark, target, "2024-01-01") == 0
    deliver(spark, inbox, [("new", "{}", 9)])
    landing.land(topic(spark, inbox), "s1", str(tmp_path), target)
    assert landing.compact(spark, target, "2024-01-01") == 2
    assert landing.landed(spark, target).count() == 6


@pytest.fixture
def folded(spark, tmp_path, request):
    database = f"fold_{request.node.name}"
    return f"{database}.current", f"{database}.changes", str(tmp_path / "cp")


def test_stream_folds_into_a_latest_wins_table(spark, tmp_path, folded):
    table, changes, checkpoint = folded
    inbox = tmp_path / "in"

    def drain():
        batches = upsert.collect_changes(topic(spark, inbox), ["kafka_key"], "kafka_offset",
                                         changes, checkpoint)
        return batches, upsert.fold(spark, changes, table, ["kafka_key"], "kafka_offset")

    deliver(spark, inbox, [("a", "1", 1), ("a", "2", 2), ("b", "1", 3)])
    deliver(spark, inbox, [("a", "3", 4), ("a", "2", 2)])
    batches, done = drain()
    assert batches == 2 and done.version == 1
    rows = {r.kafka_key: r.payload for r in spark.table(table).collect()}
    assert rows == {"a": "3", "b": "1"}

    assert drain() == (0, None)
    deliver(spark, inbox, [("a", "late", 2), ("b", "2", 9), ("c", "1", 10)])
    _, done = drain()
    rows = {r.kafka_key: r.payload for r in spark.table(table).collect()}
    assert rows == {"a": "3", "b": "2", "c": "1"} and done.version == 2

    assert spark.table(changes).count() == 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path, folded):
    table, changes, checkpoint = folded
    inbox = tmp_path / "in"
    deliver(spark, inbox, [("a", "1", 1), ("b", "1", 2)])
    for lost in ("first", "second"):  # the checkpoint of the first drain is lost
        upsert.collect_changes(topic(spark, inbox), ["kafka_key"], "kafka_offset", changes,
                               f"{checkpoint}_{lost}")
    assert upsert.fold(spark, changes, table, ["kafka_key"], "kafka_offset").rows == 2
    before = sorted(map(str, spark.table(table).collect()))
    upsert.collect_changes(topic(spark, inbox), ["kafka_key"], "kafka_offset", changes,
                           f"{checkpoint}_third")
    upsert.fold(spark, changes, table, ["kafka_key"], "kafka_offset")
    assert sorted(map(str, spark.table(table).collect())) == before
    assert upsert.fold(spark, changes, table, ["kafka_key"], "kafka_offset") is None


def test_new_data_after_a_lost_checkpoint_is_folded(spark, tmp_path, folded):
    table, changes, checkpoint = folded
    deliver(spark, tmp_path / "one", [("a", "1", 1)])
    deliver(spark, tmp_path / "one", [("b", "1", 2)])
    upsert.collect_changes(topic(spark, tmp_path / "one"), ["kafka_key"], "kafka_offset", changes,
                           checkpoint)
    upsert.fold(spark, changes, table, ["kafka_key"], "kafka_offset")
    deliver(spark, tmp_path / "two", [("new", "1", 3)])  # batch numbers start at 0 again
    assert upsert.collect_changes(topic(spark, tmp_path / "two"), ["kafka_key"], "kafka_offset",
                                  changes, f"{checkpoint}_again") == 1
    upsert.fold(spark, changes, table, ["kafka_key"], "kafka_offset")
    assert sorted(r.kafka_key for r in spark.table(table).collect()) == ["a", "b", "new"]
    assert spark.table(changes).count() == 0


def test_changes_are_spread_although_one_key_dominates(spark, tmp_path, folded):
    table, changes, checkpoint = folded
    inbox = tmp_path / "in"
    deliver(spark, inbox, [("hot" if i % 3 else f"k{i}", str(i), i) for i in range(300)])
    upsert.collect_changes(topic(spark, inbox), ["kafka_key"], "kafka_offset", changes,
                           checkpoint)
    upsert.fold(spark, changes, table, ["kafka_key"], "kafka_offset")
    rows = {r.kafka_key: r.payload for r in spark.table(table).collect()}
    assert len(rows) == 101 and rows["hot"] == "299"


@pytest.mark.parametrize("kind", ["table", "folder"])
def test_refused_rows_are_kept_with_all_reasons_and_once(spark, tmp_path, kind):
    inbox = tmp_path / "in"
    target = "land_refused.t" if kind == "table" else f"parquet:{tmp_path}/landed"
    strict = (*landing.DROP, Expectation("payload_not_empty", "length(payload) > 0"))

    def drain(root="r"):
        return landing.land(topic(spark, inbox), "s1", f"{tmp_path}/{root}", target, strict, (), keep_refused=True)

    def reasons():
        return sorted((r.kafka_key, tuple(r._reasons)) for r in landing.quarantined(spark, target).collect())

    deliver(spark, inbox, [("a", "{}", 1)])
    drain()
    assert landing.quarantined(spark, target) is None  # nothing refused yet, nothing written
    deliver(spark, inbox, [("b", "", 2), ("c", "", None), ("d", "{}", None), ("e", "{}", 5)])
    done = drain()
    names = tuple(rule.name for rule in strict)
    refused = [("b", names[1:]), ("c", names), ("d", names[:1])]
    assert (done.rows_kept, reasons()) == (1, refused)
    (tmp_path / "r/_checkpoints/s1/commits/1").unlink()  # the batch runs again
    (tmp_path / "r/_checkpoints/s1/commits/.1.crc").unlink()
    assert drain().rows_read == 4 and reasons() == refused
    assert sorted(r.kafka_key for r in landing.landed(spark, target).collect()) == ["a", "e"]
    landing.compact(spark, target, "2024-01-01")
    landing.sweep(spark, target)
    assert reasons() == refused and landing.landed(spark, target).count() == 2


def test_refused_rows_of_a_torn_batch_are_not_seen(spark, tmp_path, monkeypatch):
    inbox, target = tmp_path / "in", f"parquet:{tmp_path}/landed"
    deliver(spark, inbox, [("a", "{}", None), ("b", "{}", 1)])
    commit = landing.Sink.commit
    monkeypatch.setattr(landing.Sink, "commit", lambda *a, **k: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision"):
        landing.land(topic(spark, inbox), "s1", str(tmp_path), target, keep_refused=True)
    assert (tmp_path / "landed/_refused").exists() and landing.quarantined(spark, target) is None
    monkeypatch.setattr(landing.Sink, "commit", commit)
    landing.land(topic(spark, inbox), "s1", str(tmp_path), target, keep_refused=True)
    assert [r.kafka_key for r in landing.quarantined(spark, target).collect()] == ["a"]
    assert [r.kafka_key for r in landing.landed(spark, target).collect()] == ["b"]
