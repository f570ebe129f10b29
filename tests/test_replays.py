import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import landing
from tidemark.streaming.replays import Once, OnceLanding

SCHEMA = "id BIGINT, at TIMESTAMP_NTZ, note STRING"
START = datetime(2024, 1, 1)


def hour(n):
    return START + timedelta(hours=n)


def deliver(spark, folder, rows):
    """Drop one file of (id, hours, note) into the folder; None hours are no event time."""
    df = spark.createDataFrame([(i, None if h is None else hour(h), n) for i, h, n in rows], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/inbox")


def drain(spark, once, root):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/inbox")
    return once.drain(stream, "s", str(root))


def ids(df):
    return sorted(-1 if r.id is None else r.id for r in df.collect())


@pytest.fixture(params=["folder", "table"])
def once(request, spark, tmp_path):
    target = f"parquet:{tmp_path}/out" if request.param == "folder" else f"replays.t{uuid.uuid4().hex}"
    return OnceLanding(spark, target, ("id",), "at", timedelta(hours=10))


def test_replays_land_once_and_late_records_beside(spark, once, tmp_path):
    deliver(spark, tmp_path, [(1, 0, "a"), (2, 20, "a"), (2, 20, "a"), (None, 20, "x"), (3, None, "x")])
    assert drain(spark, once, tmp_path) == Once(5, 2, 1, 2)
    assert ids(once.rows()) == [1, 2] and ids(once.late()) == [-1, 3]
    deliver(spark, tmp_path, [(2, 20, "a"), (4, 10, "on the mark"), (5, 9, "behind"), (1, 0, "a"), (6, 30, "a")])
    assert drain(spark, once, tmp_path) == Once(5, 2, 1, 2)
    assert ids(once.rows()) == [1, 2, 4, 6] and ids(once.late()) == [-1, 1, 3, 5]
    assert ids(once.settled()) == [5]
    assert drain(spark, once, tmp_path) == Once(0, 0, 0, 0)


def test_a_new_checkpoint_goes_on_from_the_old_marks(spark, once, tmp_path):
    deliver(spark, tmp_path, [(i, i, "a") for i in range(30)])
    drain(spark, once, tmp_path)
    deliver(spark, tmp_path, [(i, i, "a") for i in range(25, 40)])
    again = OnceLanding(spark, once.target, once.keys, once.at, once.delay)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/inbox")
    done = again.drain(stream, "s", f"{tmp_path}/other")
    # The mark is at hour 19: 0 to 18 come behind it, 19 to 29 and five of them twice are replays.
    assert done == Once(45, 10, 16, 19)
    assert ids(once.rows()) == list(range(40)) and ids(once.settled()) == []


def test_a_batch_that_runs_again_replaces_itself(spark, once, tmp_path):
    deliver(spark, tmp_path, [(1, 0, "a"), (2, 50, "a")])
    drain(spark, once, tmp_path)
    deliver(spark, tmp_path, [(2, 50, "a"), (3, 60, "a"), (4, 1, "late")])
    assert drain(spark, once, tmp_path) == Once(3, 1, 1, 1)
    done = tmp_path / "_checkpoints" / "s" / "commits"
    (done / "1").unlink()
    (done / ".1.crc").unlink(missing_ok=True)
    assert drain(spark, once, tmp_path) == Once(3, 1, 1, 1)
    assert ids(once.rows()) == [1, 2, 3] and ids(once.late()) == [4] and ids(once.settled()) == [4]


def test_a_torn_batch_is_not_seen(spark, once, tmp_path, monkeypatch):
    deliver(spark, tmp_path, [(1, 0, "a")])
    commit = landing.Sink.commit
    monkeypatch.setattr(landing.Sink, "commit", lambda *a, **k: 1 / 0)
    with pytest.raises(Exception):
        drain(spark, once, tmp_path)
    monkeypatch.setattr(landing.Sink, "commit", commit)
    assert drain(spark, once, tmp_path) == Once(1, 1, 0, 0)
    assert ids(once.rows()) == [1]


def test_state_stays_within_the_delay(spark, tmp_path):
    once = OnceLanding(spark, f"parquet:{tmp_path}/out", ("id",), "at", timedelta(hours=10))
    for day in range(4):
        deliver(spark, tmp_path, [(100 * day + h, 24 * day + h, "a") for h in range(24)])
    drain(spark, once, tmp_path)
    latest = once._before("")
    assert len(latest) == 4
    fields = spark.read.parquet(f"{tmp_path}/inbox").schema
    assert once._seen(fields, latest, once._mark(latest)).count() == 11  # of 96 keys
    assert once.sweep() == 1
    assert len(list((tmp_path / "out" / "_seen").glob("_batch=*"))) == 1
    deliver(spark, tmp_path, [(300 + h, 72 + h, "a") for h in range(24)])
    assert drain(spark, once, tmp_path) == Once(24, 0, 11, 13)
    assert once.rows().count() == 96 and once.settled().count() == 0


def test_the_landed_records_are_read_by_event_date(spark, tmp_path):
    once = OnceLanding(spark, f"parquet:{tmp_path}/out", ("id",), "at", timedelta(hours=1))
    deliver(spark, tmp_path, [(i, 24 * i, "a") for i in range(5)])
    drain(spark, once, tmp_path)
    plan = once.rows().where(F.col("_load_date") == "2024-01-03")
    assert plan.count() == 1
    assert "PartitionFilters: [" in plan._jdf.queryExecution().executedPlan().toString()
