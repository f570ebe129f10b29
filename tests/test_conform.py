from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from tidemark.functions.text import snake_case, snake_case_columns
from tidemark.operators.conform import CORRUPT, MISSING, conform, parse_payload, unknown_values
from tidemark.operators.dedupe import dedupe_latest, require_unique
from tidemark.plans.usecase import UseCase

CASE = UseCase("orders", "landing.orders", "curated.orders", "mart.dim", "mart.fact", "q.orders")


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "orders_id STRING, event_ts STRING, status STRING, amount DOUBLE, currency STRING, "
              "_ingested_at TIMESTAMP_NTZ")


def test_conform_tidies_and_keeps_every_row(spark):
    now = datetime(2024, 1, 1)
    rows = [("1", "2024-01-01 10:00:00", " new ", 10.0, "eur", now),
            ("2", "not a time", "RETURNED", 1e20, None, now),
            ("3", None, None, None, "  ", now),
            ("4", "2024-01-01T10:00:00.5", "", -1.005, " usd ", now),
            ("5", "2024-01-01T10:00:00+02:00", "new", 0.0, "usd", now),
            ("6", "2024-01-01T10:00:00Z", "new", 0.0, "usd", now)]
    out = {r.orders_id: r for r in conform(raw(spark, rows), CASE.fields).collect()}
    assert len(out) == 6
    assert (out["1"].status, out["1"].currency) == ("NEW", "EUR")
    assert out["1"].amount == Decimal("10.00")
    assert out["1"].event_ts == datetime(2024, 1, 1, 10)
    assert (out["2"].event_ts, out["2"].status, out["2"].amount) == (None, None, None)
    assert out["2"].currency == out["3"].currency == "USD"
    assert out["4"].status is None and out["4"].currency == "USD"
    assert out["4"].event_ts == datetime(2024, 1, 1, 10, 0, 0, 500000)
    assert out["5"].event_ts == datetime(2024, 1, 1, 8)
    assert out["6"].event_ts == datetime(2024, 1, 1, 10)


def test_parse_tells_corrupt_from_missing(spark):
    rows = [('{"id": "a", "n": 1}',), ('{"id": "b", "n": 2, "extra": true}',),
            ('{"id": "c", "nn": 3}',), ('{"id": "d", "n": null}',), ('{"id": "e", "n": 1',),
            ('{"id": "f", "n": "x"}',), ("",), (None,)]
    out = parse_payload(spark.createDataFrame(rows, "payload STRING"), "id STRING, n INT",
                        keep=["payload"]).collect()
    by_payload = {r.payload: r for r in out}
    assert len(out) == len(rows)
    assert by_payload['{"id": "a", "n": 1}'].n == 1
    assert by_payload['{"id": "b", "n": 2, "extra": true}'][MISSING] is None
    renamed = by_payload['{"id": "c", "nn": 3}']
    assert renamed[MISSING] == ["n"] and renamed[CORRUPT] is None and renamed.id == "c"
    assert by_payload['{"id": "d", "n": null}'][MISSING] is None
    for bad in ('{"id": "e", "n": 1', '{"id": "f", "n": "x"}'):
        assert by_payload[bad][CORRUPT] == bad and by_payload[bad][MISSING] is None
    assert by_payload[""][CORRUPT] == "" and by_payload[None][CORRUPT] == ""


@pytest.mark.parametrize("bad", ['{"id": "e", "n": 1', '{"id": "c", "nn": 3}'])
def test_parse_can_stop_on_the_first_bad_record(spark, bad):
    df = spark.createDataFrame([(bad,)], "payload STRING")
    with pytest.raises(Exception, match="MALFORMED_RECORD|lacks required fields: n"):
        parse_payload(df, "id STRING, n INT", mode="FAILFAST").collect()


def test_unknown_values_ignores_blank_and_known(spark):
    now = datetime(2024, 1, 1)
    rows = [("1", None, s, None, None, now) for s in ("x", "x", "new", "", None, " ")]
    out = unknown_values(raw(spark, rows), "status", ("NEW",)).collect()
    assert [(r.raw_value, r.n_rows) for r in out] == [("x", 2)]


def test_snake_case(spark):
    assert [snake_case(n) for n in ("OrderID", "order-Id", " ORDER ID ", "HTTPCode2X", "a__b",
                                         "_ingested_at")] \
        == ["order_id", "order_id", "order_id", "http_code2_x", "a_b", "_ingested_at"]
    with pytest.raises(ValueError):
        snake_case_columns(spark.createDataFrame([(1, 2)], "OrderId INT, order_id INT"))


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k STRING, ts INT, v STRING")


def test_dedupe_ties_nulls_and_idempotence(spark):
    rows = [("a", 1, "old"), ("a", 2, "z"), ("a", 2, "b"), ("b", None, "n"), ("b", 0, "m"),
            ("c", None, "only"), (None, 1, "x"), (None, 2, "y")]
    df = keyed(spark, rows)
    once = dedupe_latest(df, ["k"], "ts")
    assert {(r.k, r.ts, r.v) for r in once.collect()} == {
        ("a", 2, "b"), ("b", 0, "m"), ("c", None, "only"), (None, 2, "y")}
    twice = dedupe_latest(once, ["k"], "ts")
    assert twice.exceptAll(once).isEmpty() and once.exceptAll(twice).isEmpty()
    first = dedupe_latest(df, ["k"], "ts", ascending=True)
    assert {r.v for r in first.collect()} == {"old", "m", "only", "x"}
    assert dedupe_latest(df.limit(0), ["k"], "ts").count() == 0
    with pytest.raises(ValueError):
        dedupe_latest(df, [], "ts")


def test_dedupe_prunes_before_the_exchange(spark):
    plan = dedupe_latest(keyed(spark, [("a", 1, "x")]), ["k"], "ts") \
        ._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:]


def test_dedupe_does_not_depend_on_partitioning(spark):
    df = spark.range(20000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 500 as string)) k",
                                       "cast(id % 7 as int) ts", "cast(id % 11 as string) v")
    expected = set(map(tuple, dedupe_latest(df, ["k"], "ts").collect()))
    assert set(map(tuple, dedupe_latest(df.repartition(13), ["k"], "ts").collect())) == expected


@pytest.mark.parametrize("rows", [[("a", 1, "x"), ("a", 2, "y")], [(None, 1, "x")]])
def test_require_unique_names_the_key(spark, rows):
    with pytest.raises(PySparkException, match="NULL or repeated"):
        require_unique(keyed(spark, rows), ["k"]).collect()


def test_require_unique_keeps_rows_and_order_of_columns(spark):
    df = keyed(spark, [("a", 1, "x"), ("b", None, None)]).select("v", "k", "ts")
    out = require_unique(df, ["k"])
    assert out.columns == df.columns
    assert out.exceptAll(df).isEmpty() and out.count() == 2
