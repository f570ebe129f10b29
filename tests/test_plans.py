import json
import random
from dataclasses import replace
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import ntz
from tidemark.operators import dims, quality, recon
from tidemark.operators.contracts import add_column
from tidemark.plans import audit, evolve, landing, reconcile, tables, usecase
from tidemark.plans import registry as seeding
from tidemark.plans.context import RunContext
from tidemark.sources.registry import RegistryError, SourceSpec, declared, read_specs
from tidemark.sources.kafka import decode_envelope
from tidemark.streaming import landing as streams
from tidemark.streaming.landing import Drained

T0 = datetime(2024, 1, 10, 4)


class Clock:
    def __init__(self, start=T0):
        self.now = start

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


@pytest.fixture
def ctx(spark, request):
    name = request.node.name.replace("[", "_").replace("]", "_").lower()
    return RunContext("run1", "curate", "us1", "prod", ops=f"ops_{name}", clock=Clock())


def case_for(ctx, entity="orders", **more):
    db = ctx.ops.replace("ops_", "db_")
    return usecase.UseCase(entity, f"{db}.landing", f"{db}.curated", f"{db}.dim", f"{db}.fact",
                           f"{db}.quarantine", **more)


def message(i, ts="2024-01-01 10:00:00", status="new", amount=1.0, currency=None,
            entity="orders"):
    return json.dumps({f"{entity}_id": i, "event_ts": ts, "status": status, "amount": amount,
                       "currency": currency})


def put(spark, case, payloads, at=T0, load_date="2024-01-10"):
    rows = spark.createDataFrame([(p, at, load_date) for p in payloads],
                                 "payload STRING, _ingested_at TIMESTAMP_NTZ, _load_date STRING")
    tables.append(rows, case.landing, ["_load_date"])


def quality_rows(spark, ctx):
    return spark.table(ctx.ops_table("data_quality_result"))


def statuses(spark, ctx):
    return [r.status for r in spark.table(ctx.ops_table("job_run")).orderBy("started_at").collect()]


def test_curate_keeps_latest_and_quarantines_the_unreadable(spark, ctx):
    case = case_for(ctx)
    put(spark, case, [message("a"), message("a", ts="2024-01-02 00:00:00", status="active"),
                      message("b", amount=2.5, currency=" eur"), "{broken",
                      '{"orders_id": "c", "state": "NEW"}', message(None),
                      '{"orders_id": "d", "event_ts": null, "status": "new", "amount": 0}'])
    done = usecase.curate(spark, ctx, case, raise_on_error=False)
    out = {r.orders_id: r for r in spark.table(case.curated).collect()}
    assert done.rows == 3 and set(out) == {"a", "b", "d"}
    assert out["a"].status == "ACTIVE" and out["b"].currency == "EUR"
    assert out["d"].currency == "USD" and out["d"].event_ts is None
    reasons = sorted(r.reason for r in spark.table(case.quarantine).collect())
    assert reasons == ["corrupt", "missing: event_ts,status,amount", "no id"]
    checks = {r.expectation_name: (r.rows_evaluated, r.rows_failed)
              for r in quality_rows(spark, ctx).collect()}
    assert checks == {
        "payload_readable": (7, 1), "payload_fields_present": (7, 1), "orders_id_present": (7, 1),
        "orders_id_not_null": (3, 0), "orders_id_unique": (3, 0), "status_not_null": (3, 0),
        "amount_non_negative": (3, 0)}
    load = spark.table(ctx.ops_table("table_load")).first()
    assert (load.rows_written, load.load_strategy, load.status) == (3, "full", "SUCCESS")
    assert statuses(spark, ctx) == ["SUCCESS"]


def test_quarantine_follows_what_was_read(spark, ctx):
    case = case_for(ctx)

    def reasons():
        return sorted((r._load_date, r.reason) for r in spark.table(case.quarantine).collect())

    put(spark, case, [message("a"), "{"])
    usecase.curate(spark, ctx, case)
    usecase.curate(spark, ctx, case)
    assert reasons() == [("2024-01-10", "corrupt")]
    put(spark, case, [message(None)], at=T0 + timedelta(days=1), load_date="2024-01-11")
    for _ in range(2):
        usecase.curate(spark, ctx, case, since="2024-01-11", raise_on_error=False)
        assert reasons() == [("2024-01-10", "corrupt"), ("2024-01-11", "no id")]


@pytest.mark.parametrize("use_case", sorted(usecase.ENTITIES))
def test_standard_use_cases_share_one_program(spark, use_case):
    case = usecase.UseCase.standard(use_case, key_field="ref")
    entity = usecase.ENTITIES[use_case][0]
    payload = json.dumps({"ref": "a", "event_ts": "2024-01-02", "status": "Active",
                          "amount": 1.5, "currency": "usd"})
    landed = spark.createDataFrame([(payload, T0)], "payload STRING, _ingested_at TIMESTAMP_NTZ")
    curated = usecase.curated_rows(usecase.parsed(landed, case), case)
    assert curated.columns[0] == f"{entity}_id" == case.id
    assert (curated.first()[0], curated.first().status) == ("a", "ACTIVE")
    dim = usecase.dim_rows(spark, case, curated, ntz(T0))
    fact = usecase.fact_rows(case, curated, dim, ntz(T0)).first()
    assert (fact[case.key], fact.date_key) == (1, 20240102)
    assert case.fact == f"datamart_{use_case}.fct_{entity}"


def test_a_database_table_is_curated_from_its_columns(spark, ctx):
    case = case_for(ctx, "customers")
    rows = spark.createDataFrame(
        [("c1", "2024-01-01 00:00:00", "active ", 3.0, None), (None, None, None, None, None)],
        "CUSTOMERS_ID STRING, `Event-TS` STRING, STATUS STRING, AMOUNT DOUBLE, CURRENCY STRING")
    landing.land(spark, ctx, spec("full"), case.landing, lambda *_: rows)
    usecase.curate(spark, ctx, case, raise_on_error=False)
    row = spark.table(case.curated).first()
    assert (row.customers_id, row.status, row.currency) == ("c1", "ACTIVE", "USD")
    assert [r.reason for r in spark.table(case.quarantine).collect()] == ["no id"]


def test_a_field_renamed_upstream_stops_the_step(spark, ctx):
    case = case_for(ctx)
    put(spark, case, [message("a")])
    usecase.curate(spark, ctx, case)
    renamed = message("b").replace('"status"', '"state"')
    put(spark, case, [renamed], load_date="2024-01-11")
    with pytest.raises(quality.DataQualityError, match="payload_fields_present"):
        usecase.curate(spark, ctx, case)
    assert [r.orders_id for r in spark.table(case.curated).collect()] == ["a"]
    assert [r.reason for r in spark.table(case.quarantine).collect()] == ["missing: status"]


def test_a_breach_keeps_the_old_table_and_fails_the_task(spark, ctx):
    case = case_for(ctx)
    put(spark, case, [message("a")])
    usecase.curate(spark, ctx, case)
    put(spark, case, [message("b", status="RETURNED")])
    with pytest.raises(quality.DataQualityError, match="status_not_null"):
        usecase.curate(spark, ctx, case)
    assert [r.orders_id for r in spark.table(case.curated).collect()] == ["a"]
    assert statuses(spark, ctx) == ["SUCCESS", "FAILED"]
    breached = quality_rows(spark, ctx).filter("not passed").collect()[0]
    assert (breached.expectation_name, breached.rows_failed) == ("status_not_null", 1)
    usecase.curate(spark, ctx, case, raise_on_error=False)
    assert spark.table(case.curated).count() == 2


def test_incremental_curation_equals_a_rebuild(spark, ctx):
    case = case_for(ctx, buckets=4)
    put(spark, case, [message("a"), message("b")])
    usecase.curate(spark, ctx, case)
    put(spark, case, [message("b", ts="2024-02-01 00:00:00", status="settled"), message("c"),
                      message("a", ts="2023-01-01 00:00:00", status="cancelled")],
        load_date="2024-01-11")
    usecase.curate(spark, ctx, case, since="2024-01-11")
    grown = {(r.orders_id, r.status) for r in spark.table(case.curated).collect()}
    usecase.curate(spark, ctx, case)
    rebuilt = {(r.orders_id, r.status) for r in spark.table(case.curated).collect()}
    assert grown == rebuilt == {("a", "NEW"), ("b", "SETTLED"), ("c", "NEW")}


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moves(df):
    """Exchanges of the plan, as text."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_bucketed_tables_are_joined_in_place(spark, ctx, no_broadcast):
    case = case_for(ctx, buckets=8)
    put(spark, case, [message(str(i)) for i in range(50)])
    usecase.curate(spark, ctx, case)
    usecase.build_marts(spark, ctx, case)
    curated, dim = spark.table(case.curated), spark.table(case.dim)
    as_of = ntz(T0)

    changes = usecase.curated_rows(usecase.parsed(spark.table(case.landing), case), case)
    assert len(moves(dims.upsert_latest(curated, changes, [case.id], "event_ts"))) == 1
    assert moves(usecase.fact_rows(case, curated, dim, as_of)) == []
    # Keys of new rows and the counts that number them; neither large side.
    assert len(moves(usecase.dim_rows(spark, case, curated, as_of))) == 2

    files = spark.table(f"{case.curated}__v1").inputFiles()
    assert len(files) <= 8


def test_dates_of_landing_are_pruned(spark, ctx):
    case = case_for(ctx)
    put(spark, case, [message("a")])
    put(spark, case, [message("b")], load_date="2024-01-11")
    plan = spark.table(case.landing).filter(F.col("_load_date") >= "2024-01-11") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_load_date" in plan


def test_curated_gate_blocks_undated_rows(spark, ctx):
    case = case_for(ctx)
    put(spark, case, [message("a"), message("b", ts="whenever")])
    usecase.curate(spark, ctx, case)
    with pytest.raises(quality.DataQualityError, match="1 of 2"):
        usecase.check_curated(spark, ctx, case)
    assert usecase.check_curated(spark, ctx, case, raise_on_error=False) == {
        "total_rows": 2, "undated_rows": 1}


@pytest.mark.parametrize("entity", ["orders", "settlement"])
def test_marts_keep_keys_across_runs(spark, ctx, entity):
    case = case_for(ctx, entity)
    put(spark, case, [message("b", entity=entity), message("a", entity=entity)])
    usecase.curate(spark, ctx, case)
    counts = usecase.build_marts(spark, ctx, case)
    assert counts == {case.dim: 2, case.fact: 2}
    first = {r[case.id]: r for r in spark.table(case.dim).collect()}
    assert {k: r[case.key] for k, r in first.items()} == {"a": 1, "b": 2}

    put(spark, case, [message("0", entity=entity), message("b", "2024-03-01 00:00:00", "settled",
                                                           entity=entity)])
    usecase.curate(spark, ctx, case)
    usecase.build_marts(spark, ctx, case)
    second = {r[case.id]: r for r in spark.table(case.dim).collect()}
    assert {k: r[case.key] for k, r in second.items()} == {"a": 1, "b": 2, "0": 3}
    assert second["a"].dw_updated_at == first["a"].dw_updated_at
    assert second["b"].dw_updated_at > first["b"].dw_updated_at
    facts = {r[case.id]: r for r in spark.table(case.fact).collect()}
    assert facts["b"].date_key == 20240301 and facts["b"][case.key] == 2


def test_marts_show_nothing_when_the_fact_fails(spark, ctx):
    case = case_for(ctx)
    put(spark, case, [message("a", amount=-1.0)])
    usecase.curate(spark, ctx, case, raise_on_error=False)
    with pytest.raises(quality.DataQualityError, match="amount_non_negative"):
        usecase.build_marts(spark, ctx, case)
    assert not spark.catalog.tableExists(case.dim) and not spark.catalog.tableExists(case.fact)


def test_audit_writes_one_row_and_lets_the_error_go_on(spark, ctx):
    with pytest.raises(KeyError):
        with audit.audited(spark, ctx, "landing"):
            raise KeyError("it's " + "x" * 5000)
    row = spark.table(ctx.ops_table("job_run")).first()
    assert row.status == "FAILED" and row.error_message.startswith("KeyError")
    assert len(row.error_message) == 1000 and "Traceback" in row.error_detail
    assert (row.duration_seconds, row.env) == (1.0, "prod")


def test_bootstrap_is_repeatable_and_takes_every_row(spark, ctx):
    for _ in range(2):
        audit.bootstrap(spark, ctx)
    with audit.audited(spark, ctx, "landing"):
        audit.log(spark, ctx, "landing", [("WARN", "here", "text", {"k": "v"})])
        audit.record_loads(spark, ctx, [audit.load_row(ctx, "s", "t", 3, "full")])
    for name, rows in (("job_run", 1), ("application_log", 1), ("table_load", 1),
                       ("parity_run", 0)):
        assert spark.table(ctx.ops_table(name)).count() == rows
    row = spark.table(ctx.ops_table("application_log")).first()
    assert (row.message, row.context, row.log_date) == ("text", {"k": "v"}, "2024-01-10")
    with audit.audited(spark, replace(ctx, use_case="us2"), "landing"):
        pass
    together = audit.evidence(spark, ctx, "job_run", ["us1", "us2", "us3"])
    assert sorted(r.use_case for r in together.collect()) == ["us1", "us2"]
    for day, rows in ((10, 2), (11, 0)):
        since = datetime(2024, 1, day)
        recent = audit.evidence(spark, ctx, "job_run", ["us1", "us2", "us3"], since)
        assert recent.count() == rows
    assert "PartitionFilters: [isnotnull(env" in \
        recent._jdf.queryExecution().executedPlan().toString()


def test_context_needs_ids():
    with pytest.raises(ValueError):
        RunContext("", "t", "us1", "prod")


def spec(strategy="incremental", source_id="s1"):
    return SourceSpec(source_id, "us2", "oracle", "CRM.T", "t", strategy,
                      watermark_column="changed" if strategy == "incremental" else None)


def source(spark, rows):
    df = spark.createDataFrame(rows, "id INT, changed TIMESTAMP_NTZ")

    def read(_, mark):
        from tidemark.sources.jdbc import newer_than
        return newer_than(df, "changed", mark)

    return read


def test_incremental_landing_moves_the_mark_after_the_data(spark, ctx):
    table = ctx.ops.replace("ops_", "db_") + ".t"
    first = landing.land(spark, ctx, spec(), table,
                         source(spark, [(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))]))
    assert (first.rows, first.mark) == (2, datetime(2024, 1, 2))
    more = [(2, datetime(2024, 1, 2)), (3, datetime(2024, 1, 3, 0, 0, 0, 1))]
    second = landing.land(spark, ctx, spec(), table, source(spark, more))
    assert (second.rows, second.mark) == (1, datetime(2024, 1, 3, 0, 0, 0, 1))
    third = landing.land(spark, ctx, spec(), table, source(spark, more))
    assert (third.rows, third.mark) == (0, datetime(2024, 1, 3, 0, 0, 0, 1))
    assert spark.table(table).count() == 3
    loads = spark.table(ctx.ops_table("table_load")).orderBy("loaded_at").collect()
    assert [(r.rows_written, r.watermark_from, r.watermark_to) for r in loads][:2] == [
        (2, None, "2024-01-02T00:00:00"),
        (1, "2024-01-02T00:00:00", "2024-01-03T00:00:00.000001")]
    landing.reset_mark(spark, ctx, "s1", datetime(2024, 1, 1))
    assert landing.land(spark, ctx, spec(), table, source(spark, more)).rows == 2


def test_full_landing_replaces_and_copy_moves_a_layer(spark, ctx):
    table = ctx.ops.replace("ops_", "db_") + ".t"
    for rows in ([(1, None), (2, None)], [(3, None)]):
        assert landing.land(spark, ctx, spec("full"), table, source(spark, rows)).rows == len(rows)
    assert [r.id for r in spark.table(table).collect()] == [3]
    assert landing.copy_layer(spark, ctx, table, table + "_next") == 1


def test_one_failing_source_does_not_stop_the_others(spark, ctx):
    good = source(spark, [(1, datetime(2024, 1, 1))])

    def read(which, mark):
        if which.source_id == "bad":
            raise RuntimeError("no route")
        return good(which, mark)

    db = ctx.ops.replace("ops_", "db_")
    out = landing.land_all(spark, ctx, [spec(source_id="a"), spec(source_id="bad"),
                                        spec(source_id="b")],
                           lambda s: f"{db}.{s.source_id}", read, at_once=2)
    assert [(r.source_id, r.rows, r.error) for r in out] == [
        ("a", 1, None), ("bad", 0, "RuntimeError: no route"), ("b", 1, None)]
    logged = {r.source_id: r.status for r in spark.table(ctx.ops_table("table_load")).collect()}
    assert logged == {"a": "SUCCESS", "bad": "FAILED", "b": "SUCCESS"}
    with pytest.raises(landing.LandingIncomplete, match=r"2 rows landed: \['bad'\]"):
        landing.summarise(spark, ctx)
    other = replace(ctx, run_id="run2")
    landing.land_all(spark, other, [spec(source_id="a")], lambda s: f"{db}.{s.source_id}",
                     source(spark, [(9, datetime(2025, 1, 1))]))
    landing.record_drained(spark, other, [Drained("k", 7, {"rows": 7, "dropped": 2})], str)
    assert landing.summarise(spark, other) == 6


def test_appends_grow_the_schema_and_refuse_a_changed_type(spark, ctx):
    name = ctx.ops.replace("ops_", "db_") + ".grow"
    tables.append(spark.createDataFrame([(1, "d1")], "id INT, d STRING"), name, ["d"])
    tables.append(spark.createDataFrame([("x", 2, "d2")], "extra STRING, id INT, d STRING"), name,
                  ["d"])
    tables.append(spark.createDataFrame([(3, "d2")], "id INT, d STRING"), name, ["d"])
    assert {(r.id, r.extra, r.d) for r in spark.table(name).collect()} == {
        (1, None, "d1"), (2, "x", "d2"), (3, None, "d2")}
    with pytest.raises(ValueError, match="id is bigint"):
        tables.append(spark.createDataFrame([(1, "d")], "id BIGINT, d STRING"), name, ["d"])


def test_old_log_days_are_dropped_whole(spark, ctx):
    for day in (1, 2, 3):
        at = replace(ctx, clock=Clock(datetime(2024, 1, day)))
        audit.log(spark, at, "landing", [("INFO", "here", f"day {day}", {"a": "b"})])
    name = ctx.ops_table("application_log")
    assert tables.drop_expired_days(spark, name, "log_date", "2024-01-03") == 2
    assert [r.message for r in spark.table(name).collect()] == ["day 3"]
    assert tables.drop_expired_days(spark, name, "log_date", "2024-01-03") == 0


def test_publish_keeps_earlier_versions_for_running_readers(spark, ctx):
    name = ctx.ops.replace("ops_", "db_") + ".snap"
    for n in (1, 2, 3, 4):
        done = tables.publish(spark.range(n), name)
        assert (done.version, done.rows, spark.table(name).count()) == (n, n, n)
    assert not spark.catalog.tableExists(f"{name}__v2")
    assert spark.catalog.tableExists(f"{name}__v3")
    tables.publish(spark.table(name).filter("id > 1"), name, up_to=9)
    assert spark.table(name).count() == 2 and tables.folded_up_to(spark, name) == 9


def test_a_bucket_is_one_file_wherever_the_rows_come_from(spark, ctx):
    name = ctx.ops.replace("ops_", "db_") + ".b"
    rows = spark.range(0, 1000, 1, 6).selectExpr("cast(id as string) id")
    for buckets in (8, 4):
        tables.publish(rows, name, bucket_by=["id"], buckets=buckets)
        files = spark.table(f"{name}__v{tables.version_of(spark, name)}").inputFiles()
        assert len(files) == buckets and spark.table(name).count() == 1000


CONFIG = {"use_case": "us1", "targets": [
    {"name": "orders", "target_table": "now_orders", "source_ref": "was_orders",
     "key_columns": ["id"], "checks": [{"name": "n", "check_type": "row_count"},
                                       {"name": "h", "check_type": "column_hash", "column": "v"}]},
    {"name": "same", "target_table": "now_same", "source_ref": "was_same",
     "checks": [{"name": "n", "check_type": "row_count"}]}]}


def test_reconcile_records_findings(spark, ctx):
    spark.range(5).selectExpr("id", "id as v").createOrReplaceTempView("was_orders")
    spark.range(1, 5).selectExpr("id", "id * 2 as v").createOrReplaceTempView("now_orders")
    for name in ("was_same", "now_same"):
        spark.range(3).createOrReplaceTempView(name)
    config = recon.load_config(CONFIG)
    with audit.audited(spark, replace(ctx, task_key="publish_marts"), "datamart"):
        pass
    gate = reconcile.etl_gate(spark, ctx)
    assert gate.proceed
    runs = reconcile.reconcile(spark, ctx, config, gate, spark.table)
    assert {r["target_name"]: r["status"] for r in runs} == {"orders": "FAILED", "same": "PASSED"}
    found = spark.table(ctx.ops_table("parity_exception")).groupBy("check_name").count().collect()
    assert {(r.check_name, r["count"]) for r in found} == {("missing_in_target", 1), ("v", 4)}
    checks = spark.table(ctx.ops_table("parity_check_result"))
    assert checks.filter("target_name = 'orders' and check_name = 'n'").first().difference == 1
    assert statuses(spark, ctx)[-1] == "SUCCESS"


def test_reconcile_skips_when_the_load_did_not_run(spark, ctx):
    with pytest.raises(RuntimeError):
        with audit.audited(spark, replace(ctx, task_key="publish_marts"), "datamart"):
            raise RuntimeError("late")
    gate = reconcile.etl_gate(spark, ctx)
    assert not gate.proceed and "within 24 hours" in gate.reason
    runs = reconcile.reconcile(spark, ctx, recon.load_config(CONFIG), gate, spark.table)
    assert {r["status"] for r in runs} == {"SKIPPED"}
    logged = spark.table(ctx.ops_table("parity_run")).collect()
    assert all(not r.overall_passed and r.checks_passed == 0 and r.notes == gate.reason
               for r in logged)
    assert not spark.catalog.tableExists(ctx.ops_table("parity_check_result"))


def declaration(*ids, use_case="us2", **more):
    return {"use_case": use_case, "sources": [
        {"source_id": i, "source_system": "oracle", "source_object": "CRM.T",
         "target_table": i, "load_strategy": "full", **more} for i in ids]}


def test_registry_follows_its_declaration(spark, ctx):
    first = declared(declaration("a", "b", primary_keys="id, no", options={"x": 1}))
    assert seeding.seed(spark, ctx, first, dry_run=True) == {"insert": 2}
    assert seeding.stored(spark, ctx).count() == 0
    assert seeding.seed(spark, ctx, first) == {"insert": 2}
    assert seeding.seed(spark, ctx, first) == {"unchanged": 2}
    other = declared(declaration("z", use_case="us9"))
    assert seeding.seed(spark, ctx, other, use_case="us9") == {"insert": 1, "out_of_scope": 2}
    assert seeding.seed(spark, ctx, declared(declaration("b", primary_keys="id")),
                        use_case="us2") == {"update": 1, "deactivate": 1, "out_of_scope": 1}
    specs = read_specs(seeding.stored(spark, ctx))
    assert [(s.source_id, s.primary_keys, s.options) for s in specs] == [
        ("b", ("id",), {}), ("z", (), {})]
    assert statuses(spark, ctx) == ["SUCCESS"] * 3


@pytest.mark.parametrize("raw", [
    {}, {"use_case": "us2", "sources": []}, declaration("a", "a"), declaration(""),
    declaration("a", colour="red"), declaration("a", load_strategy="incremental"),
    declaration("a", options={"partition_column": "id"}), declaration("a", use_case="us1")])
def test_bad_declarations_are_refused(raw):
    with pytest.raises((RegistryError, ValueError)):
        declared(raw, "us2")


def test_changes_apply_once_in_order_and_refuse_edits(spark, ctx):
    table = ctx.ops.replace("ops_", "db_") + ".t"
    tables.publish(spark.range(3), table)
    add = evolve.Change("V002__add_x", "a", lambda df: add_column(df, "x", "int", F.lit(5)))
    double = evolve.Change("V010__double_x", "b", lambda df: df.withColumn("x", F.col("x") * 2))
    assert evolve.migrate(spark, ctx, table, [double, add]) == ["V002__add_x", "V010__double_x"]
    assert {r.x for r in spark.table(table).collect()} == {10}
    assert tables.version_of(spark, table) == 2
    assert evolve.migrate(spark, ctx, table, [add, double]) == []
    assert {r.x for r in spark.table(table).collect()} == {10}
    with pytest.raises(evolve.ChangeError, match="edited"):
        evolve.migrate(spark, ctx, table, [replace(add, checksum="z"), double])
    with pytest.raises(evolve.ChangeError, match="share a version"):
        evolve.migrate(spark, ctx, table, [add, replace(add, filename="V2__other")])
    with pytest.raises(evolve.ChangeError, match="expected V"):
        evolve.migrate(spark, ctx, table, [replace(add, filename="add_x")])


def test_a_failed_change_is_not_recorded(spark, ctx):
    table = ctx.ops.replace("ops_", "db_") + ".t"
    tables.publish(spark.range(3), table)
    bad = evolve.Change("V001__bad", "a", lambda df: df.withColumn("x", F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        evolve.migrate(spark, ctx, table, [bad])
    assert spark.table(table).columns == ["id"]
    assert evolve.migrate(spark, ctx, table, [replace(bad, step=lambda df: df)]) == ["V001__bad"]


def test_from_a_topic_to_the_marts(spark, ctx, tmp_path):
    """Stream files in, land, curate by load date, build marts, reconcile with the source."""
    records = ("key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, "
               "timestamp TIMESTAMP")
    case = replace(case_for(ctx, buckets=8), landing=f"parquet:{tmp_path / 'landed'}")

    def deliver(day, payloads):
        rows = [(b"k", p.encode(), "orders", 0, i, datetime(2024, 1, day))
                for i, p in enumerate(payloads)]
        spark.createDataFrame(rows, records).write.mode("append").parquet(str(tmp_path / "in"))
        stream = decode_envelope(spark.readStream.schema(records).parquet(str(tmp_path / "in")),
                                 F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp"))
        done = streams.land(stream, "orders", str(tmp_path), case.landing)
        landing.record_drained(spark, ctx, [done], str)
        return done

    assert deliver(1, [message("a"), message("b"), "{"]).rows_kept == 3
    usecase.curate(spark, ctx, case)
    usecase.build_marts(spark, ctx, case)
    assert deliver(2, [message("b", "2024-05-01 00:00:00", "settled"), message("c")]).rows_kept == 2
    done = usecase.curate(spark, ctx, case, since="2024-01-02")
    counts = usecase.build_marts(spark, replace(ctx, task_key="publish_marts"), case)
    assert done.rows == 3 and set(counts.values()) == {3}
    dim = {r.orders_id: (r.orders_key, r.status) for r in spark.table(case.dim).collect()}
    assert dim == {"a": (1, "NEW"), "b": (2, "SETTLED"), "c": (3, "NEW")}
    assert [r.reason for r in spark.table(case.quarantine).collect()] == ["corrupt"]

    config = recon.load_config({"use_case": "us1", "targets": [
        {"name": "fact", "target_table": case.fact, "source_ref": case.curated,
         "checks": [{"name": "n", "check_type": "row_count"},
                    {"name": "sum", "check_type": "column_sum", "column": "amount"},
                    {"name": "ids", "check_type": "column_hash", "column": "orders_id"}]}]})
    gate = reconcile.etl_gate(spark, ctx)
    assert [r["status"] for r in reconcile.reconcile(spark, ctx, config, gate, spark.table)] \
        == ["PASSED"]


@pytest.mark.parametrize("kind, values, mark", [
    ("DATE", [date(2024, 1, 1), date(2024, 1, 2)], datetime(2024, 1, 2)),
    ("TIMESTAMP_NTZ", [datetime(2024, 1, 1), datetime(2024, 1, 2, 3)], datetime(2024, 1, 2, 3)),
    ("INT", [1, 2], 2), ("BIGINT", [1, 2**53 + 1], 2**53 + 1),
    ("DECIMAL(12,2)", [Decimal("1.00"), Decimal("12.75")], Decimal("12.75")),
], ids=["date", "timestamp", "int", "bigint", "decimal"])
def test_a_batch_lands_once_whatever_its_mark(spark, ctx, kind, values, mark):
    from tidemark.sources.jdbc import newer_than
    table = ctx.ops.replace("ops_", "db_") + ".t"
    rows = spark.createDataFrame([(v,) for v in values], f"changed {kind}")
    read = lambda _, known: newer_than(rows, "changed", known)
    assert landing.land(spark, ctx, spec(), table, read).mark == mark
    again = landing.land(spark, ctx, spec(), table, read)
    assert (again.rows, again.mark) == (0, mark) and spark.table(table).count() == 2


def test_a_text_mark_is_refused_before_anything_lands(spark, ctx):
    table = ctx.ops.replace("ops_", "db_") + ".t"
    rows = spark.createDataFrame([("a",)], "changed STRING")
    with pytest.raises(ValueError, match="cannot carry a mark"):
        landing.land(spark, ctx, spec(), table, lambda *_: rows)
    assert not spark.catalog.tableExists(table)


@pytest.mark.parametrize("seed", [1, 2], ids=["one", "two"])
def test_any_slicing_of_ties_gives_the_rows_of_a_rebuild(spark, ctx, seed):
    rng = random.Random(seed)
    case = case_for(ctx)
    for day in range(1, 5):
        rows = [message(rng.choice("abcd"), ts="2024-02-01 00:00:00", status=rng.choice(
            ["new", "active", "settled"]), ) for _ in range(6)]
        put(spark, case, rows, load_date=f"2024-03-0{day}")
        usecase.curate(spark, ctx, case, since=f"2024-03-0{day}")
    grown = sorted(map(str, spark.table(case.curated).collect()))
    usecase.curate(spark, ctx, case)
    assert grown == sorted(map(str, spark.table(case.curated).collect()))


def test_a_development_copy_never_takes_a_tables_place(spark, ctx):
    name = ctx.ops.replace("ops_", "db_")
    tables.publish(spark.range(50).toDF("id"), f"{name}.t")
    sandbox = replace(ctx, env="dev")
    assert usecase.development_copy(spark, sandbox, f"{name}.t", f"{name}.t_sample", 5).rows == 5
    for where, target in ((replace(ctx, env="prod"), f"{name}.t_sample"), (sandbox, f"{name}.t")):
        with pytest.raises(ValueError):
            usecase.development_copy(spark, where, f"{name}.t", target, 5)
    assert spark.table(f"{name}.t").count() == 50


def test_publishing_carries_notes_over(spark, ctx):
    name = ctx.ops.replace("ops_", "db_") + ".t"
    tables.publish(spark.range(3), name, up_to=7)
    tables.publish(spark.range(4), name, noted={"why": "more"})
    assert tables.folded_up_to(spark, name) == 7 and tables.notes(spark, name)["why"] == "more"


def test_a_change_shown_before_a_crash_is_not_applied_again(spark, ctx, monkeypatch):
    name = ctx.ops.replace("ops_", "db_") + ".t"
    tables.publish(spark.range(3).toDF("id"), name)
    change = evolve.Change("V1__double", "c1", lambda df: df.withColumn("id", df.id * 2))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(evolve.audit, "record", crash)
        with pytest.raises(OSError):
            evolve.migrate(spark, ctx, name, [change])
    assert evolve.migrate(spark, ctx, name, [change]) == []
    assert sorted(r.id for r in spark.table(name).collect()) == [0, 2, 4]
    assert spark.table(ctx.ops_table("schema_migration")).count() == 1


def test_an_unreadable_target_does_not_erase_the_others(spark, ctx):
    spark.range(3).selectExpr("id", "id as v").createOrReplaceTempView("sound")
    spark.range(3).selectExpr("id", "id as v").createOrReplaceTempView("sound_too")
    checks = [{"name": "n", "check_type": "row_count"}, {"name": "s", "check_type": "column_sum", "column": "v"}]
    config = recon.load_config({"use_case": "us1", "targets": [
        {"name": n, "target_table": t, "source_ref": "sound", "checks": checks}
        for n, t in (("one", "sound_too"), ("two", "gone"), ("three", "sound_too"))]})
    runs = reconcile.reconcile(spark, ctx, config, reconcile.Gate(True, "go"), spark.table)
    assert [r["status"] for r in runs] == ["PASSED", "FAILED", "PASSED"]
    assert "not compared" in runs[1]["notes"]
    assert spark.table(ctx.ops_table("parity_run")).count() == 3
    assert spark.table(ctx.ops_table("parity_check_result")).count() == 4
