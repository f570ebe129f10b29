"""One reconciliation run: gate, measure, compare, record."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import ntz
from tidemark.operators import recon, reports
from tidemark.plans import audit
from tidemark.plans.context import RunContext
from tidemark.plans.tables import append

# The last task of each layer, which the gate looks for by default.
LAST_TASKS = ("publish_marts", "curated_quality_gate")


@dataclass(frozen=True)
class Gate:
    proceed: bool
    reason: str


def etl_gate(spark: SparkSession, ctx: RunContext, tasks: Sequence[str] = LAST_TASKS,
             hours: int = 24) -> Gate:
    """Whether the load being checked has run; comparing stale output proves nothing."""
    now = ctx.clock()
    # A row lies in the day its task ended, so the day the window opens on is early enough.
    log = audit.evidence(spark, ctx, "job_run", [ctx.use_case], now - timedelta(hours=hours))
    row = reports.freshness(log, ctx.use_case, ctx.env, tasks, hours, now).first()
    if row.proceed:
        return Gate(True, f"load of {ctx.use_case} last succeeded at {row.last_success}")
    return Gate(False, f"no success of {', '.join(tasks)} for {ctx.use_case} in {ctx.env} "
                       f"within {hours} hours")


def reconcile(spark: SparkSession, ctx: RunContext, config: recon.ReconConfig, gate: Gate,
              open_table: Callable[[str], DataFrame], exceptions: int = 100) -> list[dict]:
    """Compare every target and append the evidence. A mismatch is a finding, not an error.

    What reaches the driver is one row per check; mismatching rows go straight
    from the tasks to the exception table.
    """
    runs: list[dict] = []
    with audit.audited(spark, ctx, "recon"):
        for target in config.targets:
            run = {"target_name": target.name, "layer": target.layer,
                   "target_table": target.target_table, "source_ref": target.source_ref,
                   "checks_total": len(target.checks), "started_at": ctx.clock(),
                   "notes": gate.reason}
            outcome = {"status": recon.SKIPPED, "checks_passed": 0, "checks_failed": 0,
                       "overall_passed": False}
            if gate.proceed:
                try:
                    outcome = _compared(spark, ctx, target, open_table, exceptions)
                except Exception as error:
                    # An unreadable target proves nothing, and says nothing about the others.
                    outcome |= {"status": recon.FAILED, "checks_failed": len(target.checks),
                                "notes": f"not compared: {type(error).__name__}: {error}"[:1000]}
            runs.append({**run, **outcome, "ended_at": ctx.clock()})
            audit.record(spark, ctx, "parity_run", runs[-1:])
    return runs


def _compared(spark: SparkSession, ctx: RunContext, target: recon.Target,
              open_table: Callable[[str], DataFrame], exceptions: int) -> dict:
    """Measure and compare one target and record its evidence before the next one starts."""
    legacy, actual = open_table(target.source_ref), open_table(target.target_table)
    results = [row.asDict() for row in recon.compare(
        recon.measure(legacy, target.checks), recon.measure(actual, target.checks),
        target.checks).collect()]
    now = ctx.clock()
    audit.record(spark, ctx, "parity_check_result", [
        {**r, "target_name": target.name, "evaluated_at": now} for r in results])
    passed = sum(r["passed"] for r in results)
    clean = passed == len(results)
    if not clean and target.key_columns:
        _record_exceptions(ctx, target, legacy, actual, exceptions)
    return {"status": recon.PASSED if clean else recon.FAILED, "checks_passed": passed,
            "checks_failed": len(results) - passed, "overall_passed": clean}


def _record_exceptions(ctx: RunContext, target: recon.Target, legacy: DataFrame,
                       actual: DataFrame, limit: int) -> None:
    now = ctx.clock()
    shared = [c for c in legacy.columns if c in actual.columns and c not in target.key_columns]
    found = recon.exceptions(legacy, actual, target.key_columns, shared, limit)
    rows = found.select(
        F.lit(ctx.run_id).alias("recon_run_id"), F.lit(ctx.use_case).alias("use_case"),
        F.lit(target.name).alias("target_name"), "check_name", "key_values", "legacy_value",
        "target_value", ntz(now).alias("captured_at"), F.lit(ctx.env).alias("env"),
        F.lit(f"{now:%Y-%m-%d}").alias("log_date"))
    append(rows, ctx.ops_table("parity_exception"), audit.partitions_of("parity_exception"))
