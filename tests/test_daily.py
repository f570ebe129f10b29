import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.dedupe import dedupe_latest
from tidemark.operators.quality import DataQualityError, non_negative
from tidemark.plans.daily import DailyTable

SCHEMA = "id BIGINT, at TIMESTAMP_NTZ, amount DOUBLE"
START = datetime(2024, 1, 1)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.fixture
def stored(spark, tmp_path):
    table = DailyTable(spark, f"{tmp_path}/t", SCHEMA, ("id",), "at")
    history = spark.range(60_000).select(
        "id", (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 30)).alias("at"),
        (F.col("id") * 1.5).alias("amount"))
    assert len(table.fold(history).days) == 30
    return table, history


def test_one_day_against_thirty_costs_a_day(spark, stored):
    table, history = stored
    before = size(f"{table.path}/rows")
    day = START + timedelta(days=30)
    arrives = spark.range(60_000, 61_000).select("id", F.lit(day).cast("timestamp_ntz").alias("at"), F.lit(1.0).alias("amount"))
    arrives = arrives.unionAll(rows_of(spark, [(4, day, 9.0), (35, START, -1.0), (7, START + timedelta(days=7), 8.0)]))
    done = table.fold(arrives)
    # the new day; those that 4 and 7 left or lie on; 35 comes late, so its own day and the one it names
    assert done.days == ["2024-01-01", "2024-01-05", "2024-01-06", "2024-01-08", "2024-01-31"]
    assert size(f"{table.path}/rows") - before < before * 6 / 30
    wanted = dedupe_latest(history.unionAll(arrives), ["id"], "at")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(table.rows()) == key(wanted)
    opened = {part for f in table.rows(["2024-01-31"]).inputFiles() for part in f.split("/")}
    plan = table.rows(["2024-01-31"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and opened
    again = table.fold(arrives)  # 4 has left its old day by now
    assert again.days == [d for d in done.days if d != "2024-01-05"] and key(table.rows()) == key(wanted)
    assert table.sweep() == 8 and key(table.rows()) == key(wanted)


def test_a_row_that_moves_back_and_a_day_left_empty(spark, tmp_path):
    table = DailyTable(spark, f"{tmp_path}/t", SCHEMA, ("id",), "at")
    assert table.rows().count() == 0 and table.fold(rows_of(spark, [])).days == []
    table.fold(rows_of(spark, [(1, START, 1.0), (2, None, 2.0)]))
    table.fold(rows_of(spark, [(1, START + timedelta(days=1), 2.0)]))
    table.fold(rows_of(spark, [(1, START + timedelta(days=2), 3.0), (2, START, 5.0)]))
    assert sorted((r.id, r.amount) for r in table.rows().collect()) == [(1, 3.0), (2, 5.0)]
    assert table.rows(["2024-01-02"]).count() == 0 == table.rows(["none"]).count()


def test_a_breach_or_a_crash_leaves_the_table_as_it_was(spark, stored, monkeypatch):
    table, _ = stored
    bad = rows_of(spark, [(1, START + timedelta(days=40), -5.0)])
    with pytest.raises(DataQualityError, match="amount"):
        table.fold(bad, [non_negative("amount")])
    assert table.rows().count() == 60_000 and table.rows(["2024-02-10"]).count() == 0
    assert table.rows().where("id = 1").first().amount == 1.5
    table.fold(rows_of(spark, [(1, START + timedelta(days=40), 5.0)]), [non_negative("amount")])
    assert table.rows().where("id = 1").first().amount == 5.0 and table.rows().count() == 60_000
    assert table.sweep() >= 2
