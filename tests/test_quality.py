import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import quality as q


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("a", "NEW", 1.0), ("b", None, -1.0), ("c", "O'Neil", None), ("c", "back\\slash", 5.0),
         (None, "NEW", 2.0), (None, "NEW", 3.0)], "id STRING, status STRING, amount DOUBLE")


CHECKS = [q.not_null("id"), q.in_set("status", ["NEW", "O'Neil", "back\\slash"]),
          q.non_negative("amount", "warn"), q.Expectation("small", "amount < 4", "warn"),
          q.unique("id"), q.unique("id", "status", severity="warn")]


def test_null_results_are_violations_and_null_is_a_key(rows):
    out = {r.expectation_name: r for r in q.evaluate(rows, CHECKS).collect()}
    assert {k: (r.rows_evaluated, r.rows_failed, r.passed) for k, r in out.items()} == {
        "id_not_null": (6, 2, False), "status_in_set": (6, 1, False),
        "amount_non_negative": (6, 2, False), "small": (6, 2, False),
        "id_unique": (6, 2, False), "id_status_unique": (6, 1, False)}


def test_empty_table_passes(rows):
    out = q.evaluate(rows.limit(0), CHECKS).collect()
    assert all(r.passed and r.rows_evaluated == 0 for r in out)


def test_row_checks_share_one_scan(rows, spark, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = q.evaluate(df, CHECKS[:4])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_gate_stops_on_error_only(rows):
    results = [r.asDict() for r in q.evaluate(rows, CHECKS).collect()]
    with pytest.raises(q.DataQualityError, match="id_not_null"):
        q.gate(results, "t")
    assert len(q.gate(results, "t", raise_on_error=False)) == 3
    assert q.gate([r for r in results if r["severity"] == "warn"], "t") == []


def test_counts_ride_on_the_write(rows, tmp_path):
    seen = Observation()
    rows.observe(seen, *q.violation_counts(CHECKS)).write.parquet(str(tmp_path / "t"))
    observed = q.results_of(seen.get, CHECKS)
    measured = [r.asDict() for r in q.evaluate(rows, CHECKS[:4]).collect()]
    assert observed == measured


def test_split_loses_nothing_and_names_the_reasons(rows):
    kept, rejected = q.split(rows, CHECKS)
    assert kept.count() + rejected.count() == rows.count()
    reasons = {(r.id, r.status): r._failed_checks for r in rejected.collect()}
    assert reasons[("b", None)] == ["status_in_set", "amount_non_negative"]
    assert [r.id for r in kept.filter("amount is null").collect()] == ["c"]
    kept, rejected = q.split(rows, [q.non_negative("amount", "warn")])
    assert kept.count() == 6 and rejected.count() == 0


def test_bad_expectations_are_refused():
    with pytest.raises(ValueError):
        q.Expectation("x", "a > 0", "fatal")
    with pytest.raises(ValueError):
        q.Expectation("x")


def test_undated(rows):
    out = q.undated(rows.withColumn("ts", F.when(F.col("amount") > 1, F.lit(1))), "ts").first()
    assert (out.total_rows, out.undated_rows) == (6, 3)
