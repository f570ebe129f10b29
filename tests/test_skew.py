"""One key holding a third of the rows must not gather them in one task."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import ntz
from tidemark.operators import dims, quality, readiness
from tidemark.operators.dedupe import dedupe_latest, require_unique

ROWS = 240_000


@pytest.fixture(scope="module")
def hot(spark):
    """Key -1 has a third of the rows, the others about six each."""
    return spark.range(0, ROWS, 1, 8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 27_000).alias("k"),
        F.col("id").alias("n"))


@pytest.fixture
def small_thresholds(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def shuffled_rows(df):
    """Rows each shuffle of a finished query wrote."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif name.endswith("QueryStage"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_dedupe_ships_one_row_per_key_and_task(spark, hot):
    # 8 tasks: the hot key sends 8 rows instead of 80,000.
    latest = dedupe_latest(hot, ["k"], "n")
    assert latest.count() == hot.select("k").distinct().count()
    assert latest.filter("k = -1").first().n == ROWS - 3
    shipped = latest.filter("k = -1")
    shipped.collect()
    assert max(shuffled_rows(shipped)) <= 8


def test_uniqueness_collapses_copies_before_they_move(spark, hot):
    only_hot = hot.filter("k = -1")
    counted = quality.duplicate_keys(only_hot, ["k"])
    assert [(r.k, r.n_copies) for r in counted.collect()] == [(-1, ROWS // 3)]
    assert max(shuffled_rows(counted)) <= 8
    with pytest.raises(Exception, match="repeated"):
        require_unique(only_hot, ["k"]).collect()


def test_the_fact_join_splits_the_hot_key(spark, hot, small_thresholds):
    keys = spark.range(-1, 27_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("key"))
    rows = hot.withColumns({"ts": ntz("2024-01-01"), "noise": F.xxhash64("n")})
    fact = dims.build_fact(rows, keys, "k", "key", "ts")
    totals = fact.agg(F.count(F.lit(1)).alias("rows"), F.sum("key").alias("keys"),
                      F.max("noise").alias("noise"))
    row = totals.collect()[0]
    expected = hot.agg(F.sum(F.col("k") * 2)).first()[0]
    assert (row.rows, row["keys"]) == (ROWS, expected)
    assert "skew=true" in totals._jdf.queryExecution().executedPlan().toString()


def test_one_use_case_with_most_runs_is_counted_in_parts(spark):
    day = F.make_dt_interval(F.col("id").cast("int"))
    runs = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, "busy").otherwise(F.concat(F.lit("u"), F.col("id") % 50))
        .alias("use_case"), F.lit("prod").alias("env"),
        F.col("id").cast("string").alias("recon_run_id"),
        (ntz("2000-01-01") + day).alias("started_at"), F.lit("t").alias("target_name"),
        F.when(F.col("id") == 10_001, "FAILED").otherwise("PASSED").alias("status"),
        (F.col("id") != 10_001).alias("overall_passed"))
    streaks = {r.use_case: r.clean_streak for r in readiness.clean_streak(runs).collect()}
    assert streaks["busy"] == sum(1 for i in range(10_002, 30_000) if i % 3)
