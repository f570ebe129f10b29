from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import ntz
from tidemark.operators.lineage import stamp
from tidemark.sources import files, jdbc, kafka, refs, registry
from tidemark.sources.jdbc import Connection
from tidemark.sources.splits import SourceError, Split, split_of

CONN = Connection("jdbc:oracle:thin:@db:1521/x", "u", "p")
ROWS = [
    ("ora_customers", "us2", "oracle", "CRM.CUSTOMERS", "customers", "incremental",
     "LAST_UPDATE_DT", ["id"], "scope", {"fetch": "1"}, True),
    ("ora_products", "us2", "oracle", "CRM.PRODUCTS", "products", "full", None, [], "scope",
     None, True),
    ("kfk_orders", "us1", "kafka", "orders.v1", "orders", "cdc_stream", "", None, None, None,
     True),
    ("ora_old", "us2", "oracle", "CRM.OLD", "old", "full", None, None, None, None, False),
]
DDL = ("source_id STRING, use_case STRING, source_system STRING, source_object STRING, "
       "target_table STRING, load_strategy STRING, watermark_column STRING, "
       "primary_keys ARRAY<STRING>, secret_scope STRING, options MAP<STRING,STRING>, "
       "is_active BOOLEAN")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, DDL)


def test_registry_selects_active_by_use_case_and_system(rows):
    assert [s.source_id for s in registry.read_specs(rows, "us2", "oracle")] \
        == ["ora_customers", "ora_products"]
    assert [s.source_id for s in registry.read_specs(rows)] \
        == ["kfk_orders", "ora_customers", "ora_products"]
    spec = registry.read_specs(rows, source_ids=["ora_customers"])[0]
    assert spec.primary_keys == ("id",) and spec.options == {"fetch": "1"}


def test_registry_errors(rows):
    with pytest.raises(registry.RegistryError, match="empty"):
        registry.read_specs(rows.limit(0))
    for asked in (["nope"], ["ora_old"], ["ora_customers", "kfk_orders"]):
        with pytest.raises(registry.RegistryError, match="unknown or inactive"):
            registry.read_specs(rows, "us2", source_ids=asked)


@pytest.mark.parametrize("change", [{"source_system": "ftp"}, {"load_strategy": "sometimes"},
                                    {"load_strategy": "incremental"}])
def test_bad_specs_are_refused(change):
    row = dict(source_id="x", use_case="u", source_system="oracle", source_object="A.B",
               target_table="t", load_strategy="full")
    with pytest.raises(registry.RegistryError):
        registry.spec_of({**row, **change})


def test_key_list():
    assert registry.key_list(" a, b ,,c") == ("a", "b", "c")
    assert registry.key_list(None) == () == registry.key_list("")


def test_jdbc_options_use_a_partitionable_form():
    split = Split("id", 1, 5_000_000, 8)
    options = jdbc.read_options(CONN, "CRM.CUSTOMERS", split)
    assert options["dbtable"] == "CRM.CUSTOMERS" and "query" not in options
    assert options["fetchsize"] == "10000" and options["numPartitions"] == "8"
    plain = jdbc.read_options(CONN, "CRM.CUSTOMERS")
    assert not {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} & set(plain)


@pytest.mark.parametrize("options", [
    {"partition_column": "id"},
    {"partition_column": "id", "lower_bound": "1", "upper_bound": "9"},
    {"partition_column": "id", "lower_bound": "9", "upper_bound": "1", "num_partitions": "2"},
    {"partition_column": "id", "lower_bound": "1", "upper_bound": "9", "num_partitions": "0"},
    {"partition_column": "id", "lower_bound": "a", "upper_bound": "9", "num_partitions": "2"},
    {"partition_column": "id", "split_points": "5,3"}])
def test_incomplete_splits_are_refused(options):
    with pytest.raises(SourceError):
        split_of(options)


@pytest.mark.parametrize("split", [Split("id", 0, 100, 8), Split("id", 5, 7, 8),
                                   Split("id", points=(3, 4, 90)), Split("id", 0, 10, 1)])
def test_split_predicates_cover_every_row_once(spark, split):
    df = spark.range(-20, 150).select("id").unionByName(
        spark.createDataFrame([(None,)], "id BIGINT"))
    parts = [df.filter(p) for p in split.predicates()]
    assert sum(p.count() for p in parts) == df.count()
    numbered = df.groupBy(split.number().alias("n")).count().collect()
    assert {r.n: r["count"] for r in numbered} == \
        {i: p.count() for i, p in enumerate(parts) if p.count()}


@pytest.mark.parametrize("name", ["T", "a.b.c", "a.b;drop", "a. b", ".b"])
def test_only_plain_names_reach_the_database(name):
    with pytest.raises(SourceError):
        jdbc.checked_name(name)
    assert jdbc.checked_name("CRM.CUSTOMER_$1") == "CRM.CUSTOMER_$1"


def test_database_reads_refuse_streams(spark):
    spec = registry.spec_of(dict(zip(DDL_NAMES, ROWS[2])))
    with pytest.raises(SourceError):
        jdbc.read_source(spark, CONN, spec, None)


DDL_NAMES = [part.split()[0] for part in DDL.split(", ")]


def test_newer_is_strict_and_first_load_reads_all(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 1, 0, 0, 1)),
                                (3, None)], "id INT, ts TIMESTAMP_NTZ")
    assert jdbc.newer_than(df, "ts", None).count() == 3
    assert [r.id for r in jdbc.newer_than(df, "ts", datetime(2024, 1, 1)).collect()] == [2]
    assert [r.id for r in jdbc.newer_than(df, "id", 2).collect()] == [3]


def test_overlap_sets_the_mark_back():
    at = datetime(2024, 1, 1)
    assert jdbc.looked_back(at, 3600) == datetime(2023, 12, 31, 23)
    assert (jdbc.looked_back(100, 10), jdbc.looked_back(None, 10), jdbc.looked_back(at, 0)) \
        == (90, None, at)


def test_mark_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = jdbc.newer_than(orders, "o_orderdate", datetime(2000, 1, 1)) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate,2000-01-01T00:00)" in plan


def test_kafka_options():
    spec = registry.spec_of({**dict(zip(DDL_NAMES, ROWS[2])),
                             "options": {"starting_offsets": "latest",
                                         "max_offsets_per_trigger": 2000000,
                                         "fail_on_data_loss": True}})
    options = kafka.stream_options(spec, "broker:9092", "s3cret")
    assert options["subscribe"] == "orders.v1" and options["startingOffsets"] == "latest"
    assert options["maxOffsetsPerTrigger"] == "2000000"
    assert options["failOnDataLoss"] == "true"
    assert options["kafka.security.protocol"] == "SASL_SSL"
    assert "s3cret" in options["kafka.sasl.jaas.config"]
    plain = kafka.stream_options(registry.spec_of(dict(zip(DDL_NAMES, ROWS[2]))), "b")
    assert (plain["startingOffsets"], plain["failOnDataLoss"], plain["maxOffsetsPerTrigger"]) \
        == ("earliest", "false", "500000")
    assert not any("sasl" in name for name in plain)
    with pytest.raises(ValueError):
        kafka.stream_options(spec, "")


def test_envelope_is_lossless(spark):
    records = spark.createDataFrame(
        [(b"k", "{broken é".encode(), "t", 1, 2, datetime(2024, 1, 1)),
         (None, None, "t", 1, 3, datetime(2024, 1, 1))],
        "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, "
        "timestamp TIMESTAMP")
    out = kafka.decode_envelope(records, F.lit(datetime(2024, 2, 1))).collect()
    assert [(r.kafka_key, r.payload, r.kafka_offset) for r in out] == \
        [("k", "{broken é", 2), (None, None, 3)]


def test_stamp(spark):
    row = stamp(spark.range(1), "s", "r", ntz("2024-01-01")).first()
    assert (row._source_id, row._run_id, row._ingested_at) == ("s", "r", datetime(2024, 1, 1))


def test_files_keep_what_does_not_fit(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "n": 2}\n{"id": 2, "n": "x"}\nnot json\n')
    out = files.read_files(spark, str(tmp_path / "a.json"), "json", "id INT, n INT").collect()
    assert [(r.id, r.n) for r in out if r._corrupt is None] == [(1, 2)]
    assert sorted(r._corrupt for r in out if r._corrupt) == ["not json", '{"id": 2, "n": "x"}']
    (tmp_path / "a.csv").write_text("id,n\n1,2\n2,x\n")
    out = files.read_files(spark, str(tmp_path / "a.csv"), "csv", "id INT, n INT").collect()
    assert [r._corrupt for r in out] == [None, "2,x"]
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path), "xls", "id INT")


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_typed_files_round_trip(spark, tmp_path, fmt):
    spark.range(3).write.format(fmt).save(str(tmp_path / "x"))
    assert files.read_files(spark, str(tmp_path / "x"), fmt, "id BIGINT").count() == 3
    assert refs.open_ref(spark, f"{fmt}:{tmp_path / 'x'}").count() == 3


def test_refs(spark):
    spark.range(2).createOrReplaceTempView("some_view")
    assert refs.open_ref(spark, "some_view").count() == 2
    opened = refs.open_ref(spark, "jdbc:CRM.T", {"jdbc": lambda name: spark.range(len(name))})
    assert opened.count() == 5
    with pytest.raises(ValueError):
        refs.open_ref(spark, "ftp:x")


def test_merged_schemas(spark, tmp_path):
    path = str(tmp_path / "grown")
    spark.range(2).write.parquet(path)
    spark.range(2).selectExpr("id", "'x' as extra").write.mode("append").parquet(path)
    merged = files.read_merged(spark, path)
    assert set(merged.columns) == {"id", "extra"} and merged.filter("extra is null").count() == 2


class RecordingSession:
    """Stands in for a session whose database is not here: keeps what it was asked for."""

    def __init__(self, table):
        self.table, self.asked = table, {}

    @property
    def read(self):
        return self

    def format(self, name):
        self.asked["format"] = name
        return self

    def options(self, **options):
        self.asked["options"] = options
        return self

    def load(self):
        return self.table

    def jdbc(self, url, table, predicates, properties):
        self.asked.update(url=url, table=table, predicates=predicates, properties=properties)
        return self.table


@pytest.fixture
def database(spark):
    return RecordingSession(spark.createDataFrame(
        [(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 2)), (3, "c", None)],
        "ID INT, NAME STRING, LAST_UPDATE_DT TIMESTAMP_NTZ"))


def spec_with(**changes):
    return registry.spec_of({**dict(zip(DDL_NAMES, ROWS[0])), **changes})


def test_incremental_reads_filter_and_prune(database):
    spec = spec_with(options={"columns": "ID, LAST_UPDATE_DT"})
    out = jdbc.read_source(database, CONN, spec, datetime(2024, 1, 1))
    assert out.columns == ["ID", "LAST_UPDATE_DT"] and [r.ID for r in out.collect()] == [2]
    assert database.asked["format"] == "jdbc"
    assert database.asked["options"]["dbtable"] == "CRM.CUSTOMERS"
    assert jdbc.read_source(database, CONN, spec, None).count() == 3
    late = spec_with(options={"overlap": "1"})
    assert jdbc.read_source(database, CONN, late, datetime(2024, 1, 2)).count() == 1


def test_full_reads_ignore_the_mark(database):
    spec = spec_with(load_strategy="full", watermark_column=None)
    assert jdbc.read_source(database, CONN, spec, datetime(2024, 1, 2)).count() == 3


def test_uneven_tables_are_cut_at_points(database):
    jdbc.read_source(database, CONN, spec_with(options={"partition_column": "ID",
                                                        "split_points": "10,20"}), None)
    assert database.asked["predicates"] == ["ID < 10 OR ID IS NULL", "ID >= 10 AND ID < 20",
                                            "ID >= 20"]
    assert database.asked["properties"]["fetchsize"] == "10000"
    assert "url" not in database.asked["properties"]


def test_even_tables_are_cut_by_the_database_reader(database):
    jdbc.read_source(database, CONN, spec_with(options={
        "partition_column": "ID", "lower_bound": "1", "upper_bound": "100",
        "num_partitions": "4"}), None)
    options = database.asked["options"]
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"],
            options["numPartitions"]) == ("ID", "1", "100", "4")
