import pytest
from pyspark.sql import functions as F

from tidemark.operators import digest_tree, sketches
from tidemark.sources.splits import points_from

FAN = digest_tree.Fan(buckets=32, branches=16)


@pytest.fixture
def sides(spark, tmp_path):
    def stored(df, name):
        return digest_tree.store(df, f"{tmp_path}/{name}", ["k"], ["v", "w"], FAN)
    return stored


def found(result):
    return sorted(tuple(r) for r in result.rows.collect())


def test_only_buckets_that_differ_are_opened(spark, sides):
    left = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("v"), F.lit("x").alias("w"))
    right = left.where("k <> 7").withColumn("v", F.when(F.col("k") == 11, 99.0).otherwise(F.col("v"))).unionAll(
        spark.createDataFrame([(9000, 1.0, None)], "k long, v double, w string"))
    right = right.withColumn("v", F.col("v").cast("decimal(20,6)"))  # another type for the same values
    a, b = sides(left, "a"), sides(right, "b")
    result = digest_tree.compare(a, b, ["k"])
    assert found(result) == [(7, "only_left"), (11, "changed"), (9000, "only_right")]
    assert 1 <= len(result.buckets) <= 3
    plan = a.where(F.col("_bucket").isin(result.buckets))
    assert {f"_bucket={n}" for n in result.buckets} == {
        part for r in plan.select(F.input_file_name()).distinct().collect() for part in r[0].split("/") if "_bucket=" in part}
    assert digest_tree.compare(a, a, ["k"]).buckets == [] and found(digest_tree.compare(a, a, ["k"])) == []


def test_repeated_keys_nulls_and_swapped_values(spark, sides):
    schema = "k int, v double, w string"
    left = [(1, 1.0, "a"), (1, 1.0, "a"), (1, 2.0, "b"), (2, None, "a"), (3, 1.0, None), (None, 1.0, "n"), (4, 4.0, "q"), (4, 5.0, "q")]
    right = [(1, 2.0, "b"), (1, 1.0, "a"), (2, None, "a"), (3, None, "1.0"), (None, 1.0, "n"), (4, 5.0, "q"), (4, 4.0, "q")]
    a, b = (sides(spark.createDataFrame(r, schema), n) for r, n in ((left, "a"), (right, "b")))
    assert found(digest_tree.compare(a, b, ["k"])) == [(1, "only_left"), (3, "changed")]
    empty = sides(spark.createDataFrame([], schema), "none")
    assert {r.status for r in digest_tree.compare(a, empty, ["k"]).rows.collect()} == {"only_left"}
    assert found(digest_tree.compare(empty, empty, ["k"])) == []


def test_sketches_of_days_add_up(spark):
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") % 17_000).alias("a"),
                                      F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("b"))
    first = sketches.daily(rows.where("day < 4"), "day", ["a", "b"])
    state = sketches.extended(first, rows, "day", ["a", "b"])
    total = sketches.estimates(state, ["a", "b"]).first()
    assert state.count() == 6 and total["rows"] == 60_000
    for name, exact in (("a", 17_000), ("b", 30_000)):
        assert abs(total[name] - exact) <= 4 * sketches.error() * exact
    again = sketches.extended(state, rows, "day", ["a", "b"])
    assert again.count() == 6  # no day twice


def test_points_follow_the_keys(spark):
    keys = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 500 + 10**6).otherwise(
        F.col("id") * 1000).alias("k"))
    split = points_from(keys, "k", 10)
    sizes = [r["count"] for r in keys.groupBy(split.number().alias("read")).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 30_000 and max(sizes) <= 2 * 3_000
    assert points_from(keys.limit(0), "k", 4).predicates() == ["1 = 1"]
    one = spark.createDataFrame([(5,), (5,), (None,)], "k long")
    assert points_from(one, "k", 4).predicates() == ["1 = 1"]
