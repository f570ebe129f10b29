from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import ntz
from tidemark.operators import sync
from tidemark.sources.jdbc import newer_than

OLD, NOW = datetime(2023, 1, 1), datetime(2024, 1, 1)
WANT = "source_id STRING, use_case STRING, keys STRING, options MAP<STRING,STRING>, " \
       "is_active BOOLEAN"
HAVE = WANT + ", created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
OWNED = ["use_case", "keys", "options", "is_active"]


@pytest.fixture(scope="module")
def desired(spark):
    return spark.createDataFrame(
        [("new", "us1", "id", {"a": "1"}, True), ("same", "us1", "", {}, True),
         ("map_order", "us1", None, {"b": "2", "a": "1"}, True),
         ("changed", "us1", "id2", None, True), ("back", "us1", "id", None, True),
         ("elsewhere", "us2", "id", None, True)], WANT)


@pytest.fixture(scope="module")
def existing(spark):
    return spark.createDataFrame(
        [("same", "us1", None, None, True, OLD, OLD),
         ("map_order", "us1", " ", {"a": "1", "b": "2"}, True, OLD, OLD),
         ("changed", "us1", "id", None, True, OLD, OLD),
         ("back", "us1", "id", None, False, OLD, OLD),
         ("missing", "us1", "id", None, True, OLD, OLD),
         ("off", "us1", "id", None, False, OLD, OLD),
         ("other", "us2", "id", None, True, OLD, OLD)], HAVE)


def actions(df):
    return {r.source_id: r.action for r in df.collect()}


def test_plan(desired, existing):
    assert actions(sync.plan(desired, existing, "source_id", OWNED)) == {
        "new": "insert", "elsewhere": "insert", "same": "unchanged", "map_order": "unchanged",
        "changed": "update", "back": "update", "missing": "deactivate", "off": "retired",
        "other": "deactivate"}


def test_scope_leaves_others_alone(desired, existing):
    out = actions(sync.plan(desired, existing, "source_id", OWNED, scope="use_case = 'us1'"))
    assert out["other"] == "out_of_scope" and "elsewhere" not in out
    assert out["missing"] == "deactivate"


def test_keep_missing(desired, existing):
    out = actions(sync.plan(desired, existing, "source_id", OWNED, deactivate_missing=False))
    assert out["missing"] == "unchanged"


def test_apply_never_deletes_and_stamps_only_changes(desired, existing):
    out = {r.source_id: r
           for r in sync.apply(desired, existing, "source_id", OWNED, ntz(NOW)).collect()}
    assert len(out) == 9
    assert out["missing"].is_active is False and out["missing"].updated_at == NOW
    assert out["same"].updated_at == OLD and out["off"].updated_at == OLD
    assert (out["new"].created_at, out["new"].options) == (NOW, {"a": "1"})
    assert (out["changed"].keys, out["changed"].created_at) == ("id2", OLD)
    assert out["back"].is_active is True


def test_apply_twice_is_once(desired, existing):
    once = sync.apply(desired, existing, "source_id", OWNED, ntz(NOW))
    assert {r.action for r in sync.summary(sync.plan(desired, once, "source_id", OWNED))
            .collect()} == {"unchanged", "retired"}


def test_repeated_desired_id_fails(desired, existing):
    with pytest.raises(PySparkException, match="NULL or repeated"):
        sync.plan(desired.unionAll(desired), existing, "source_id", OWNED).collect()


def marks(spark, rows):
    return spark.createDataFrame([(*row[:3], None, None, row[3]) for row in rows], sync.MARKS_DDL)


def test_marks_only_move_forward_and_compare_typed(spark):
    stored = marks(spark, [("num", None, 9, OLD), ("time", datetime(2024, 5, 1), None, OLD),
                           ("back", datetime(2024, 5, 1), None, OLD), ("idle", None, 1, OLD)])
    batch = marks(spark, [("num", None, 10, None),
                          ("time", datetime(2024, 5, 1, 0, 0, 0, 500), None, None),
                          ("back", datetime(2024, 4, 1), None, None), ("first", None, 3, None)])
    out = {r.source_id: r for r in sync.advance(stored, batch, ntz(NOW)).collect()}
    assert (out["num"].long_value, out["num"].updated_at) == (10, NOW)
    assert out["time"].ts_value == datetime(2024, 5, 1, 0, 0, 0, 500)
    assert (out["back"].ts_value, out["back"].updated_at) == (datetime(2024, 5, 1), OLD)
    assert out["idle"].updated_at == OLD
    assert (out["first"].long_value, out["first"].updated_at) == (3, NOW)


def test_reset_is_deliberate_and_read_returns_the_kind(spark):
    stored = marks(spark, [("a", datetime(2024, 5, 1), None, OLD), ("n", None, 9, OLD)])
    moved = sync.reset(stored, "a", datetime(2024, 1, 1), ntz(NOW))
    assert sync.read_mark(moved, "a") == datetime(2024, 1, 1)
    assert sync.read_mark(sync.reset(stored, "n", 2, ntz(NOW)), "n") == 2
    assert sync.read_mark(moved, "n") == 9 and sync.read_mark(moved, "unknown") is None


def test_ledger(spark):
    ddl = "filename STRING, checksum STRING"
    available = spark.createDataFrame([("v1", "a"), ("v2", "b"), ("v3", "c")], ddl)
    applied = spark.createDataFrame([("v1", "a"), ("v2", "x")], ddl)
    out = {r.filename: r.state for r in sync.ledger(available, applied).collect()}
    assert out == {"v1": "applied", "v2": "drifted", "v3": "pending"}


def test_the_kind_of_a_mark_follows_its_column():
    kinds = {T.DateType(): "ts_value", T.TimestampNTZType(): "ts_value", T.ShortType(): "long_value",
             T.DecimalType(12, 2): "exact_value", T.DoubleType(): "real_value"}
    assert {t: sync.mark_column(t, "c") for t in kinds} == kinds
    with pytest.raises(ValueError, match="cannot carry a mark"):
        sync.mark_column(T.StringType(), "c")


def test_a_floating_mark_is_exact_and_passes_over_nothing(spark):
    rows = spark.createDataFrame([(0.12345678905,), (0.1,), (float("nan"),), (float("inf"),), (None,)], "v double")
    mark = rows.agg(sync.mark_value("v", T.DoubleType())).first()[0]
    assert mark == 0.12345678905
    later = spark.createDataFrame([(0.12345678907,), (0.12345678905,)], "v double")
    assert [r.v for r in newer_than(later, "v", mark).collect()] == [0.12345678907]
    stored = sync.advance(spark.createDataFrame([], sync.MARKS_DDL), sync.batch_marks(
        rows, "s", real="v"), F.lit("2024-01-01"))
    assert sync.read_mark(stored, "s") == mark
    with pytest.raises(ValueError, match="cannot carry a mark"):
        sync.mark_column(T.DecimalType(38, 12), "v")
