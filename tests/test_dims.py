from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.times import ntz
from tidemark.operators import dims

OLD, NOW = datetime(2024, 1, 1), datetime(2024, 2, 1)
DIM = "k BIGINT, id STRING, status STRING, currency STRING, at TIMESTAMP_NTZ, " \
      "dw_updated_at TIMESTAMP_NTZ"


def dim(spark, rows):
    return spark.createDataFrame([(*r, OLD, OLD) for r in rows], DIM)


def source(spark, rows):
    return spark.createDataFrame([(*r, NOW) for r in rows],
                                 "id STRING, status STRING, currency STRING, at TIMESTAMP_NTZ")


def upsert(target, changes, **more):
    return dims.upsert(target, changes, ["id"], ["status", "currency"], ntz(NOW), **more)


def test_upsert_insert_update_unchanged_and_target_only(spark):
    target = dim(spark, [(1, "same", "NEW", "USD"), (2, "to_null", "NEW", "USD"),
                         (3, "from_null", None, "USD"), (4, "gone", "NEW", "USD"),
                         (5, "both_null", None, None)])
    changes = source(spark, [("same", "NEW", "USD"), ("to_null", None, "USD"),
                             ("from_null", "NEW", "USD"), ("both_null", None, None),
                             ("fresh", "ACTIVE", "EUR")])
    out = {r.id: r for r in upsert(target, changes).collect()}
    assert set(out) == {"same", "to_null", "from_null", "gone", "both_null", "fresh"}
    for name in ("same", "gone", "both_null"):
        assert (out[name].dw_updated_at, out[name].at) == (OLD, OLD)
    for name, status in (("to_null", None), ("from_null", "NEW"), ("fresh", "ACTIVE")):
        assert (out[name].status, out[name].dw_updated_at, out[name].at) == (status, NOW, NOW)
    assert out["to_null"].k == 2 and out["fresh"].k is None


def test_upsert_twice_is_once(spark):
    target = dim(spark, [(1, "a", "NEW", "USD")])
    changes = source(spark, [("a", "ACTIVE", "USD"), ("b", "NEW", "EUR")])
    once = upsert(target, changes)
    twice = dims.upsert(once, changes, ["id"], ["status", "currency"], ntz("2024-03-01"))
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


@pytest.mark.parametrize("ids", [["a", "a"], [None]])
def test_upsert_refuses_repeated_and_null_keys(spark, ids):
    changes = source(spark, [(i, "NEW", "USD") for i in ids])
    with pytest.raises(PySparkException, match="NULL or repeated"):
        upsert(dim(spark, []), changes).collect()


def test_upsert_moves_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upsert(dim(spark, [(1, "a", "NEW", "USD")]), source(spark, [("a", "X", "Y")])) \
            ._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 2


def test_surrogate_keys_are_stable_dense_and_ordered(spark):
    existing = spark.createDataFrame([("m", 7), ("c", 3)], "id STRING, k BIGINT")
    incoming = spark.createDataFrame([(i,) for i in "zacmb"] + [(None,)], "id STRING")
    out = {r.id: r.k for r in dims.assign_keys(existing, incoming, "id", "k").collect()}
    assert out == {"m": 7, "c": 3, "a": 8, "b": 9, "z": 10, None: None}


def test_surrogate_keys_from_nothing(spark):
    incoming = spark.range(5000).selectExpr("id * 3 as id").repartition(16)
    empty = spark.createDataFrame([], "id BIGINT, k BIGINT")
    out = dims.assign_keys(empty, incoming, "id", "k")
    assert out.filter(F.col("k") != F.col("id") / 3 + 1).isEmpty()
    assert out.select("k").distinct().count() == 5000


def test_surrogate_keys_when_nothing_is_new(spark):
    known = spark.createDataFrame([("a", 4)], "id STRING, k BIGINT")
    out = dims.assign_keys(known, spark.createDataFrame([("a",)], "id STRING"), "id", "k")
    assert [(r.id, r.k) for r in out.collect()] == [("a", 4)]


def test_surrogate_keys_survive_repeated_input(spark):
    incoming = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id STRING, v INT")
    empty = spark.createDataFrame([], "id STRING, k BIGINT")
    out = dims.assign_keys(empty, incoming, "id", "k")
    assert sorted((r.id, r.v, r.k) for r in out.collect()) == [("a", 1, 1), ("a", 2, 1),
                                                              ("b", 3, 2)]


def test_refresh_inserts_with_keys_and_is_repeatable(spark):
    target = dim(spark, [(3, "b", "NEW", "USD"), (9, "z", "NEW", "USD")])
    changes = source(spark, [("b", "ACTIVE", "USD"), ("c", "NEW", "EUR"), ("a", None, None)])

    def refreshed(current):
        return dims.refresh(current, changes, "id", "k", ["status", "currency"], ntz(NOW))

    once = refreshed(target)
    assert {r.id: (r.k, r.status) for r in once.collect()} == {
        "b": (3, "ACTIVE"), "z": (9, "NEW"), "a": (10, None), "c": (11, "NEW")}
    twice = refreshed(once)
    assert twice.exceptAll(once).isEmpty() and once.exceptAll(twice).isEmpty()
    with pytest.raises(PySparkException, match="NULL or repeated"):
        dims.refresh(target, changes.unionAll(changes), "id", "k", ["status"], ntz(NOW)).collect()


def test_fact_keeps_orphans_and_drops_unnamed(spark):
    curated = spark.createDataFrame(
        [("a", datetime(2024, 3, 9)), ("x", None), (None, datetime(2024, 1, 1))],
        "id STRING, ts TIMESTAMP_NTZ")
    keys = spark.createDataFrame([("a", 5)], "id STRING, k BIGINT")
    out = {r.id: r for r in dims.build_fact(curated, keys, "id", "k", "ts").collect()}
    assert set(out) == {"a", "x"}
    assert (out["a"].k, out["a"].date_key) == (5, 20240309)
    assert (out["x"].k, out["x"].date_key) == (None, None)
    assert [r.id for r in dims.orphans(curated, keys, "id").filter("id is not null").collect()] \
        == ["x"]


def test_latest_wins_ignores_older_changes(spark):
    ddl = "id STRING, ts INT, v STRING"
    current = spark.createDataFrame([("a", 5, "now"), ("b", 1, "old"), ("n", None, "?")], ddl)
    changes = spark.createDataFrame([("a", 4, "late"), ("b", 2, "new"), ("c", 1, "first"),
                                     ("n", 0, "dated")], ddl)
    out = dims.upsert_latest(current, changes, ["id"], "ts")
    assert {(r.id, r.v) for r in out.collect()} == {("a", "now"), ("b", "new"), ("c", "first"),
                                                    ("n", "dated")}
    again = dims.upsert_latest(out, changes, ["id"], "ts")
    assert again.exceptAll(out).isEmpty() and out.exceptAll(again).isEmpty()


def test_totals_are_exact_decimals(spark):
    df = spark.range(1000).selectExpr("20240101 as date_key", "0.1D as amount")
    row = dims.daily_totals(df, "amount").first()
    assert str(row.revenue) == "100.00" and row.n_rows == 1000
