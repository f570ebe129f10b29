"""One generic use case: landed records to a curated table, a dimension and a fact.

Orders, customers, events, inventory and settlement differ only in the nouns, so
they are five configurations of these steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import snake_case_columns
from tidemark.functions.times import ntz
from tidemark.operators import dims, quality
from tidemark.operators.conform import CORRUPT, MISSING, Field, conform, parse_payload
from tidemark.operators.contracts import contract, enforce
from tidemark.operators.dedupe import dedupe_latest
from tidemark.plans import audit, tables
from tidemark.plans.context import RunContext
from tidemark.sources.refs import open_ref
from tidemark.streaming import landing as streams

# The statuses the marts understand, and the currency when none is given.
STATUSES = ("NEW", "ACTIVE", "SETTLED", "CANCELLED")
DEFAULT_CURRENCY = "USD"


# The use cases, their entity and the landed table it is curated from.
ENTITIES = {"us1": ("orders", "kfk_orders"), "us2": ("customers", "ora_customers"),
            "us3": ("events", "kfk_events"), "us4": ("inventory", "kfk_orders"),
            "us5": ("settlement", "kfk_orders")}


@dataclass(frozen=True)
class UseCase:
    """The nouns of a use case: its entity, and the tables it reads and owns.

    ``landing`` is a table, or the folder a stream lands in (``parquet:/path``).
    ``key_field`` names the landed field that holds the id, where that differs.
    """

    entity: str
    landing: str
    curated: str
    dim: str
    fact: str
    quarantine: str
    buckets: int = 0
    key_field: str = ""

    @classmethod
    def standard(cls, use_case: str, buckets: int = 0, key_field: str = "") -> UseCase:
        """One of the standard use cases, in databases named after layer and use case."""
        entity, landed = ENTITIES[use_case]
        curated, mart = f"curated_{use_case}", f"datamart_{use_case}"
        return cls(entity, f"landing_{use_case}.{landed}", f"{curated}.{entity}",
                   f"{mart}.dim_{entity}", f"{mart}.fct_{entity}",
                   f"{curated}.quarantine_{entity}", buckets, key_field)

    def layout(self) -> dict:
        """Bucketed by id when the configuration gives a number of buckets."""
        if not self.buckets:
            return {}
        return {"bucket_by": [self.id], "buckets": self.buckets, "placed": True}

    @property
    def id(self) -> str:
        return f"{self.entity}_id"

    @property
    def landed_id(self) -> str:
        return self.key_field or self.id

    @property
    def key(self) -> str:
        return f"{self.entity}_key"

    @property
    def payload(self) -> str:
        return (f"{self.landed_id} STRING, event_ts STRING, status STRING, amount DOUBLE, "
                "currency STRING")

    @property
    def fields(self) -> tuple[Field, ...]:
        return (
            Field(self.id, self.landed_id),
            Field("event_ts", type="timestamp_ntz"),
            Field("status", allowed=STATUSES),
            Field("amount", type="decimal(18,2)"),
            Field("currency", code=True, default=DEFAULT_CURRENCY),
            Field("ingested_at", "_ingested_at", type="timestamp_ntz"),
        )

    @property
    def curated_contract(self) -> str:
        return (f"{self.id} STRING NOT NULL, event_ts TIMESTAMP_NTZ, status STRING, "
                "amount DECIMAL(18,2), currency STRING, ingested_at TIMESTAMP_NTZ")

    @property
    def dim_contract(self) -> str:
        return (f"{self.key} BIGINT, {self.id} STRING NOT NULL, status STRING, "
                "currency STRING, source_updated_at TIMESTAMP_NTZ, dw_updated_at TIMESTAMP_NTZ")

    @property
    def fact_contract(self) -> str:
        return (f"{self.id} STRING, {self.key} BIGINT, date_key INT, event_ts TIMESTAMP_NTZ, "
                "status STRING, amount DECIMAL(18,2), currency STRING, "
                "ingested_at TIMESTAMP_NTZ, dw_updated_at TIMESTAMP_NTZ")

    @property
    def curated_checks(self) -> tuple[quality.Expectation, ...]:
        return (quality.not_null(self.id), quality.unique(self.id), quality.not_null("status"),
                quality.non_negative("amount"))

    @property
    def mart_checks(self) -> tuple[quality.Expectation, ...]:
        return (quality.not_null(self.id), quality.unique(self.id),
                quality.non_negative("amount"))


# Where a record stood in its topic: of two with one event and ingest time the later stands.
POSITION = (Field("source_offset", "kafka_offset", type="bigint"),
            Field("source_partition", "kafka_partition", type="int"))


def _position(df: DataFrame) -> list[str]:
    return [field.source for field in POSITION if field.source in df.columns]


def parsed(landed: DataFrame, case: UseCase) -> DataFrame:
    """The record of each landed row: read from its payload, or, where a database table was
    landed column by column, its columns under conventional names."""
    if "payload" in landed.columns:
        # A field with a default may be left out; any other has to be there, or a field
        # renamed upstream would quietly read as NULL.
        required = [f.source or f.name for f in case.fields if f.default is None]
        required = [name for name in required if name in contract(case.payload).names]
        return parse_payload(landed, case.payload, required=required,
                             keep=["_ingested_at", "payload", *_position(landed)])
    named = snake_case_columns(landed)
    names = contract(case.payload).names
    return named.select(
        "_ingested_at", *_position(named), F.to_json(F.struct(*names)).alias("payload"), *names,
        F.lit(None).cast("string").alias(CORRUPT), F.lit(None).cast("array<string>").alias(MISSING))


def intake_checks(case: UseCase) -> tuple[quality.Expectation, ...]:
    """What every record must be before it can become a curated row.

    A broken message is set aside and reported. A record without its fields or its id
    means that the source has changed: it stops the step, as a table that lost most of
    its rows would otherwise pass every other check.
    """
    return (quality.Expectation("payload_readable", f"{CORRUPT} IS NULL", "warn"),
            quality.Expectation("payload_fields_present", f"{MISSING} IS NULL"),
            quality.Expectation(f"{case.landed_id}_present",
                                f"{CORRUPT} IS NOT NULL OR {MISSING} IS NOT NULL "
                                f"OR {case.landed_id} IS NOT NULL"))


def usable(case: UseCase) -> Column:
    """A record that was read, has its fields and names its entity."""
    return F.col(CORRUPT).isNull() & F.col(MISSING).isNull() & F.col(case.landed_id).isNotNull()


def curated_rows(records: DataFrame, case: UseCase) -> DataFrame:
    """Parsed records to curated rows: conform, latest per id, in contract order.

    Latest is by event time, then ingest time, then place in the topic. Records of one ingest time are
    in one load date, hence in one slice: what a slice keeps and how it is folded is one order.
    """
    position = [field for field in POSITION if field.source in records.columns]
    places = [field.name for field in position]
    rows = conform(records.filter(usable(case)), (*case.fields, *position))
    latest = dedupe_latest(rows, [case.id], "event_ts", then_latest=["ingested_at", *places])
    return enforce(latest.drop(*places), contract(case.curated_contract))


def rejected_rows(records: DataFrame, case: UseCase) -> DataFrame:
    """Records that are not usable, with the reason."""
    reason = (F.when(F.col(CORRUPT).isNotNull(), "corrupt")
              .when(F.col(MISSING).isNotNull(),
                    F.concat(F.lit("missing: "), F.array_join(MISSING, ",")))
              .otherwise("no id"))
    return records.filter(~usable(case)).select(
        "payload", "_ingested_at", reason.alias("reason"),
        F.date_format("_ingested_at", "yyyy-MM-dd").alias("_load_date"))


def _quarantine(spark: SparkSession, case: UseCase, rejects: DataFrame | None,
                since: str | None) -> None:
    """Replace the quarantined rows of the load dates that were read."""
    if spark.catalog.tableExists(case.quarantine):
        tables.drop_partitions(spark, case.quarantine,
                               lambda values: not since or values["_load_date"] >= since)
    if rejects is not None:
        tables.replace_partitions(rejects, case.quarantine, "_load_date")


def _gate(spark: SparkSession, ctx: RunContext, staged: tables.Staged,
          checks: Sequence[quality.Expectation], raise_on_error: bool,
          intake: Sequence[dict] = ()) -> None:
    """Save one result per expectation, then stop if an error one is breached.

    Row predicates were counted by the write; only uniqueness reads the staged
    table again, and of that only the key column.
    """
    results = [*intake, *quality.results_of(staged.metrics, checks)]
    keyed = [e for e in checks if e.unique_columns]
    if keyed:
        found = quality.evaluate(spark.table(staged.table), keyed).collect()
        results += [row.asDict() for row in found]
    audit.record_quality(spark, ctx, staged.name, results)
    quality.gate(results, staged.name, raise_on_error)


def curate(spark: SparkSession, ctx: RunContext, case: UseCase, raise_on_error: bool = True,
           since: str | None = None) -> tables.Published:
    """Landing to curated.

    Without ``since`` the table is rebuilt from all of landing. With it, only load
    dates from then on are read (older partitions of landing are skipped) and folded
    into the current table, latest wins by the same order, so both give the same rows.

    Order: write, save the check results, gate, show, record. A breach leaves the
    previous curated table in place and the task FAILED.
    """
    with audit.audited(spark, ctx, "curated"):
        landed = streams.landed(spark, case.landing)
        if since:
            landed = landed.filter(F.col("_load_date") >= since)
        records = parsed(landed, case)
        arriving = intake_checks(case)
        seen = Observation()
        rows = curated_rows(records.observe(seen, *quality.violation_counts(arriving)), case)
        if since and spark.catalog.tableExists(case.curated):
            rows = dims.upsert_latest(spark.table(case.curated), rows, [case.id], "event_ts",
                                      then_latest=["ingested_at"])
        staged = tables.stage(rows, case.curated, quality.violation_counts(case.curated_checks),
                              **case.layout())
        # Landing is read a second time only when there is something to quarantine.
        intake = quality.results_of(seen.get, arriving)
        rejected = any(result["rows_failed"] for result in intake)
        _quarantine(spark, case, rejected_rows(records, case) if rejected else None, since)
        _gate(spark, ctx, staged, case.curated_checks, raise_on_error, intake)
        done = tables.swap(spark, staged)
        audit.record_loads(spark, ctx, [audit.load_row(
            ctx, f"{case.entity}_curated", case.curated, done.rows,
            "incremental" if since else "full")])
    return done


# Environments in which a part of a table may stand for the whole.
SANDBOXES = ("dev", "sandbox")


def development_copy(spark: SparkSession, ctx: RunContext, source: str, target: str,
                     rows: int) -> tables.Published:
    """Some rows of a table under another name, to try a step on. Refused outside a sandbox,
    and under a name that does not say what it is: no step reads it unless told to."""
    if ctx.env not in SANDBOXES:
        raise ValueError(f"{ctx.env} is no sandbox: {target} would stand for all of {source}")
    if not target.endswith("_sample"):
        raise ValueError(f"{target}: a development copy is named ..._sample")
    return tables.publish(open_ref(spark, source).limit(rows), target)


def check_curated(spark: SparkSession, ctx: RunContext, case: UseCase,
                  raise_on_error: bool = True) -> dict:
    """The gate in front of the marts: every curated row has an event time."""
    with audit.audited(spark, ctx, "curated"):
        counts = quality.undated(spark.table(case.curated), "event_ts").first().asDict()
        if counts["undated_rows"] and raise_on_error:
            raise quality.DataQualityError(
                f"{case.curated}: {counts['undated_rows']} of {counts['total_rows']} rows "
                "have no event time; the mart build is blocked")
    return counts


def dim_rows(spark: SparkSession, case: UseCase, curated: DataFrame, as_of: Column) -> DataFrame:
    """Next dimension snapshot: stable keys, type-1 attributes."""
    if spark.catalog.tableExists(case.dim):
        current = spark.table(case.dim)
    else:
        current = spark.createDataFrame([], contract(case.dim_contract))
    source = curated.select(case.id, "status", "currency",
                            F.col("event_ts").alias("source_updated_at"))
    rows = dims.refresh(current, source, case.id, case.key, ["status", "currency"], as_of,
                        checked=True)
    return enforce(rows, contract(case.dim_contract))


def fact_rows(case: UseCase, curated: DataFrame, dim: DataFrame, as_of: Column) -> DataFrame:
    rows = dims.build_fact(curated, dim, case.id, case.key, "event_ts")
    return enforce(rows.withColumn("dw_updated_at", as_of), contract(case.fact_contract))


def build_marts(spark: SparkSession, ctx: RunContext, case: UseCase,
                raise_on_error: bool = True) -> dict[str, int]:
    """Dimension, then fact, then show both: the fact is checked before either is visible."""
    with audit.audited(spark, ctx, "datamart"):
        as_of = ntz(ctx.clock())
        curated = spark.table(case.curated)
        dim = tables.stage(dim_rows(spark, case, curated, as_of), case.dim, **case.layout())
        fact = tables.stage(fact_rows(case, curated, spark.table(dim.table), as_of), case.fact,
                            quality.violation_counts(case.mart_checks))
        _gate(spark, ctx, fact, case.mart_checks, raise_on_error)
        shown = [tables.swap(spark, staged) for staged in (dim, fact)]
        audit.record_loads(spark, ctx, [
            audit.load_row(ctx, f"{ctx.use_case}.{done.name}", done.name, done.rows, "full")
            for done in shown])
    return {done.name: done.rows for done in shown}
