"""Data quality: named expectations, one pass over the data, quarantine and gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("warn", "error")


@dataclass(frozen=True)
class Expectation:
    """A condition every row must satisfy, as SQL text, with what a breach means.

    ``unique_columns`` marks a uniqueness expectation, which is about groups of
    rows and therefore has no row predicate.
    """

    name: str
    predicate: str = ""
    severity: str = "error"
    unique_columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"{self.name}: severity is one of {SEVERITIES}")
        if bool(self.predicate) == bool(self.unique_columns):
            raise ValueError(f"{self.name}: give a predicate or unique columns")

    def violated(self) -> Column:
        """True where the condition is false or NULL."""
        return ~F.coalesce(F.expr(self.predicate), F.lit(False))

    def describe(self) -> str:
        return self.predicate or f"unique ({', '.join(self.unique_columns)})"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def not_null(column: str, severity: str = "error") -> Expectation:
    return Expectation(f"{column}_not_null", f"{_quoted(column)} IS NOT NULL", severity)


def unique(*columns: str, severity: str = "error") -> Expectation:
    return Expectation("_".join(columns) + "_unique", severity=severity, unique_columns=columns)


def in_set(column: str, allowed: Sequence[str], severity: str = "error") -> Expectation:
    options = ", ".join(_text_literal(value) for value in allowed)
    return Expectation(f"{column}_in_set", f"{_quoted(column)} IN ({options})", severity)


def non_negative(column: str, severity: str = "error") -> Expectation:
    return Expectation(f"{column}_non_negative", f"{_quoted(column)} >= 0", severity)


class DataQualityError(AssertionError):
    """An ``error`` expectation was breached."""


RESULT_DDL = ("expectation_name STRING, expectation_predicate STRING, severity STRING, "
              "rows_evaluated BIGINT, rows_failed BIGINT, passed BOOLEAN")


def _result(exp: Expectation, evaluated: Column, failed: Column) -> Column:
    return F.struct(
        F.lit(exp.name).alias("expectation_name"),
        F.lit(exp.describe()).alias("expectation_predicate"),
        F.lit(exp.severity).alias("severity"),
        evaluated.cast("bigint").alias("rows_evaluated"),
        failed.cast("bigint").alias("rows_failed"),
        (failed == 0).alias("passed"),
    )


def violation_counts(expectations: Sequence[Expectation]) -> list[Column]:
    """Aggregates for one pass: the row count, then violations per row predicate."""
    rows = [e for e in expectations if e.predicate]
    return [F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(e.violated()).alias(f"_failed_{i}") for i, e in enumerate(rows)]]


def evaluate(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """One result row per expectation.

    All row predicates share a single scan. Each uniqueness expectation reads only
    its key columns; copies of a hot key collapse before the exchange.
    ``rows_failed`` of a uniqueness expectation is the number of repeated keys,
    with NULL counted as a key.
    """
    if not expectations:
        raise ValueError("no expectations given")
    parts: list[DataFrame] = []
    by_row = [e for e in expectations if e.predicate]
    if by_row:
        totals = df.agg(*violation_counts(by_row))
        parts.append(totals.select(F.inline(F.array(*[
            _result(e, F.col("_rows"), F.col(f"_failed_{i}")) for i, e in enumerate(by_row)
        ]))))
    for exp in (e for e in expectations if e.unique_columns):
        groups = df.groupBy(*exp.unique_columns).agg(F.count(F.lit(1)).alias("_copies"))
        totals = groups.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("_rows"),
                            F.count_if(F.col("_copies") > 1).alias("_failed"))
        parts.append(totals.select(F.inline(F.array(
            _result(exp, F.col("_rows"), F.col("_failed"))))))
    return reduce(DataFrame.unionByName, parts)


def results_of(counts: Mapping[str, int], expectations: Sequence[Expectation]) -> list[dict]:
    """Result rows from counts observed while the rows were written: no scan at all."""
    rows = int(counts["_rows"])
    return [
        {"expectation_name": e.name, "expectation_predicate": e.describe(),
         "severity": e.severity, "rows_evaluated": rows,
         "rows_failed": int(counts[f"_failed_{i}"]), "passed": counts[f"_failed_{i}"] == 0}
        for i, e in enumerate(e for e in expectations if e.predicate)
    ]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of copies."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_copies"))
        .filter(F.col("n_copies") > 1)
    )


def failed_names(expectations: Sequence[Expectation]) -> Column:
    """Names of the row expectations a row breaks; empty when it breaks none."""
    return F.array_compact(F.array(*[
        F.when(e.violated(), F.lit(e.name)) for e in expectations if e.predicate
    ]))


def split(df: DataFrame, expectations: Sequence[Expectation],
          reasons: str = "_failed_checks") -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rows to quarantine with the checks they break.

    Only ``error`` expectations send a row to quarantine; a ``warn`` breach is named
    on a row that is there for another reason, but does not put it there.
    """
    errors = [e for e in expectations if e.severity == "error" and e.predicate]
    if not errors:
        return df, df.withColumn(reasons, failed_names(expectations)).filter(F.lit(False))
    broken = reduce(lambda a, b: a | b, [e.violated() for e in errors])
    return df.filter(~broken), df.filter(broken).withColumn(reasons, failed_names(expectations))


def report(results: DataFrame) -> DataFrame:
    """Failures first, then by table and expectation."""
    leading = [c for c in ("table_name",) if c in results.columns]
    return results.orderBy("passed", *leading, "expectation_name")


def breaches(results: Sequence[dict]) -> list[str]:
    return [f"{r['expectation_name']} ({r['rows_failed']}/{r['rows_evaluated']} rows)"
            for r in results if r["severity"] == "error" and not r["passed"]]


def gate(results: Sequence[dict], what: str, raise_on_error: bool = True) -> list[str]:
    """Stop on a breached ``error`` expectation. Call it after the results are saved."""
    found = breaches(results)
    if found and raise_on_error:
        raise DataQualityError(f"{what}: {len(found)} expectation(s) breached: {'; '.join(found)}")
    return found


def undated(df: DataFrame, ts: str) -> DataFrame:
    """Total rows, and rows with no event time: what blocks a mart build."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(F.col(ts).isNull()).alias("undated_rows"))
