"""Staging, publish, audits, runs, JDBC options and incremental load."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.functions.types import UnsupportedTypeError
from tablelift.operators.audits import is_lossy, null_violations
from tablelift.plans.expressions import cast, copy_of
from tablelift.plans.plan import Approval, Plan
from tablelift.session import new_run_dir
from tablelift.sinks.publish import PublishRefused, publish
from tablelift.sinks.staging import (
    TransferError, drop_staging, file_evidence, landed, stage, staging_database, staging_name, staging_schema, totals,
)
from tablelift.sources.jdbc import Relation, Split, scan_options
from tablelift.sources.tables import columns_of, is_cut, query, scan
from tablelift.streaming.load import batch_evidence, load_stream, loaded, read_files
from tablelift.workflow import full_run, load, replayed

CUSTOMERS = [(1, "Asha"), (2, "Rahul"), (3, "Neha")]


@pytest.fixture(scope="module")
def database(spark):
    return staging_database(spark)


def customers(spark, rows=CUSTOMERS):
    return spark.createDataFrame(rows, "customer_id bigint, full_name string")


def plan(**options):
    return Plan(
        "customers", "people",
        (
            Approval("customer_id", "APPROVED", "person_id", T.IntegerType(), 1, target_nullable=False,
                     compatibility="EXACT", transformation=cast("customer_id", "INTEGER")),
            Approval("full_name", "APPROVED", "name", T.StringType(), 2, compatibility="EXACT",
                     transformation=copy_of("full_name"), **options),
        ),
    )


def people(spark, database):
    name = f"{database}.people_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (person_id INT, name STRING, origin STRING DEFAULT 'new') USING parquet")
    return name


def test_stage_counts_and_drops(spark, database):
    transport = uuid.uuid4()
    staged = stage(customers(spark).repartition(2), transport, database)
    assert (staged.rows_read, staged.rows_written) == (3, 3) and staged.evidence(spark).count() == 1
    assert staged.frame(spark).orderBy("customer_id").collect() == customers(spark).collect()
    assert totals(customers(spark), file_evidence(staged.frame(spark))).first().complete
    with pytest.raises(TransferError) as error:
        stage(customers(spark), transport, database)
    assert error.value.category == "STAGING_EXISTS" and staged.frame(spark).count() == 3
    drop_staging(spark, staged.relation, database)
    drop_staging(spark, staged.relation, database)
    assert not spark.catalog.tableExists(f"{database}.{staging_name(transport)}")


def test_an_empty_source_is_staged_too(spark, database):
    staged = stage(customers(spark, []), uuid.uuid4(), database)
    assert (staged.rows_read, staged.rows_written) == (0, 0) and staged.frame(spark).columns == ["customer_id", "full_name"]


def test_a_failed_load_leaves_nothing_behind(spark, database):
    transport = uuid.uuid4()
    broken = customers(spark).withColumn("full_name", F.raise_error(F.lit("unreadable")).cast("string"))
    with pytest.raises(TransferError) as error:
        stage(broken, transport, database)
    assert error.value.category == "CONFIRMED_FAILED_CLEANED_UP"
    assert not spark.catalog.tableExists(f"{database}.{staging_name(transport)}")


def test_only_staging_tables_can_be_dropped(spark, database):
    for name in (f"{database}.people", "other.STAGE_" + "A" * 32, f"{database}.STAGE_{'a' * 32}", "STAGE_" + "A" * 32):
        with pytest.raises(ValueError):
            drop_staging(spark, name, database)


def test_staging_types(spark):
    frame = spark.sql(
        "SELECT CAST(1 AS SMALLINT) a, CAST(1.5 AS DECIMAL(6,2)) b, 1.5F c, map('z', 1, 'a', 2) d, array(2, 1) e,"
        " named_struct('y', 1, 'x', CAST(NULL AS INT)) f, X'01' g"
    )
    kinds = [field.dataType for field in staging_schema(frame.schema).fields]
    text = T.StringType()
    assert kinds == [T.ShortType(), T.DecimalType(6, 2), T.DoubleType(), text, text, text, T.BinaryType()]
    row = landed(frame).first()
    assert (row.d, row.e, row.f) == ('{"a":2,"z":1}', "[2,1]", '{"x":null,"y":1}')
    with pytest.raises(UnsupportedTypeError):
        staging_schema(spark.sql("SELECT INTERVAL '1' DAY AS i").schema)


def test_publish_appends_with_defaults(spark, database):
    target = people(spark, database)
    assert publish(customers(spark), plan(), target) == 3
    assert {tuple(row) for row in spark.table(target).collect()} == {(n, name, "new") for n, name in CUSTOMERS}


def test_publish_refuses_nulls_overflow_and_open_plans(spark, database):
    target = people(spark, database)
    for rows in ([(None, "x")], [(2**40, "x")]):
        with pytest.raises(PublishRefused):
            publish(customers(spark, rows), plan(), target)
    pending = Plan("s", "t", (*plan().approvals, Approval("extra")))
    with pytest.raises(PublishRefused):
        publish(customers(spark), pending, target)
    assert spark.table(target).count() == 0


def test_run_records_every_step(spark, database):
    target, run = people(spark, database), uuid.uuid4()
    steps, checks, result = full_run(spark, customers(spark), plan(), target, database, run)
    assert [row.stage for row in steps.collect()] == ["STAGING", "EXECUTING", "CLEANING_UP"]
    assert result.first().status == "PASSED" and checks.count() == 5
    assert replayed(steps, str(run), plan()).count() == 3
    assert not spark.catalog.tableExists(f"{database}.{staging_name(run)}")


def test_failed_publish_still_cleans_up(spark, database):
    run = uuid.uuid4()
    steps = load(customers(spark, [(None, "x")]), plan(), people(spark, database), database, run)
    got = [(row.stage, row.status) for row in steps.collect()]
    assert got == [("STAGING", "SUCCEEDED"), ("EXECUTING", "FAILED"), ("CLEANING_UP", "SUCCEEDED")]


def test_a_failed_run_never_passes_and_is_not_validated(spark, database):
    target, run = people(spark, database), uuid.uuid4()
    publish(customers(spark), plan(), target)
    stage(customers(spark), run, database)
    steps, checks, result = full_run(spark, customers(spark), plan(), target, database, run)
    assert [(row.stage, row.status, row.detail) for row in steps.collect()] == [("STAGING", "FAILED", "STAGING_EXISTS")]
    assert result.first().status == "FAILED" and {row.status for row in checks.collect()} == {"UNAVAILABLE"}


def test_a_published_run_is_not_repeated(spark, database):
    target, run = people(spark, database), uuid.uuid4()
    first = load(customers(spark), plan(), target, database, run).collect()
    again = load(customers(spark), plan(), target, database, run)
    assert sorted(again.collect()) == sorted(first) and spark.table(target).count() == 3
    other = Plan("customers", "people", plan().approvals[:1])
    reused = load(customers(spark), other, target, database, run).collect()
    assert [(row.status, row.detail) for row in reused] == [("FAILED", "RUN_ID_REUSED")] and spark.table(target).count() == 3


def test_staging_stays_where_the_outcome_is_unknown(spark, database):
    run = uuid.uuid4()
    steps = load(customers(spark), plan(), f"{database}.no_such_table", database, run).collect()
    assert [(row.stage, row.status, row.detail) for row in steps][1:] == [("EXECUTING", "FAILED", "OUTCOME_UNCERTAIN")]
    assert spark.catalog.tableExists(f"{database}.{staging_name(run)}")


def test_null_violations(spark):
    frame = customers(spark, [(1, None), (2, None), (None, "x")])
    counts = {row.column_name: row.null_rows for row in null_violations(frame, ["customer_id", "full_name"]).collect()}
    assert counts == {"customer_id": 1, "full_name": 2}


@pytest.mark.parametrize(
    "value,source,target,lossy",
    [
        ("1.5D", T.DoubleType(), T.IntegerType(), True), ("2.0D", T.DoubleType(), T.IntegerType(), False),
        ("2147483648D", T.DoubleType(), T.IntegerType(), True), ("-2147483648D", T.DoubleType(), T.IntegerType(), False),
        ("CAST('NaN' AS DOUBLE)", T.DoubleType(), T.IntegerType(), True), ("127L", T.LongType(), T.ByteType(), False),
        ("128L", T.LongType(), T.ByteType(), True), ("99.999D", T.DoubleType(), T.DecimalType(4, 2), True),
        ("99.99D", T.DoubleType(), T.DecimalType(4, 2), False), ("99.995D", T.DoubleType(), T.DecimalType(4, 2), True),
        ("100D", T.DoubleType(), T.DecimalType(4, 2), True), ("'12'", T.StringType(), T.IntegerType(), False),
        ("'012'", T.StringType(), T.IntegerType(), True), ("'x'", T.StringType(), T.IntegerType(), True),
        ("CAST(NULL AS DOUBLE)", T.DoubleType(), T.IntegerType(), False),
        ("CAST(3.0 AS DECIMAL(10,1))", T.DecimalType(10, 1), T.IntegerType(), False),
    ],
)
def test_lossy_casts(spark, value, source, target, lossy):
    frame = spark.sql(f"SELECT {value} AS v")
    assert frame.select(is_lossy(F.col("v"), source, target)).first()[0] is lossy


def test_bounded_query_and_scan(spark):
    frame = spark.range(100)
    assert query(spark, "SELECT id FROM {f} WHERE id >= :low", {"low": 10}, max_rows=7, f=frame).count() == 7
    wide = spark.range(20_000)
    assert query(spark, "SELECT id FROM {f}", f=wide).count() == 20_000
    assert is_cut(wide, 19_999) and not is_cut(wide, 20_000)
    assert scan(customers(spark), ["full_name"]).columns == ["full_name"]
    described = columns_of(spark, {"t": spark.sql("SELECT 1 AS a, CAST(1 AS DECIMAL(9,3)) AS b").schema}).collect()
    assert [(row.canonical_type, row.numeric_precision, row.numeric_scale) for row in described] == [
        ("INTEGER", 10, 0), ("DECIMAL", 9, 3),
    ]


def test_jdbc_options():
    relation = Relation("snowflake", "S", 'a"b', "DB")
    options = scan_options("jdbc:x", relation, fetch_size=50_000, timeout_seconds=None, split=Split("id", "0", "9", 4))
    assert options["dbtable"] == '"DB"."S"."a""b"' and options["fetchsize"] == "50000"
    assert options["numPartitions"] == "4" and "queryTimeout" not in options
    timed = scan_options("jdbc:x", relation, fetch_size=None, timeout_seconds=90, split=None)
    assert timed["queryTimeout"] == "90"
    assert Relation("mysql", "d", "t", "d").quoted() == "`d`.`t`"
    for build in (
        lambda: Relation("mysql", "d", "t", "other"), lambda: Relation("mysql", "d", "t" * 65),
        lambda: Relation("oracle", "d", "t"), lambda: Relation("postgresql", "d", " "),
    ):
        with pytest.raises(ValueError):
            build()


def test_stream_load_is_bounded_and_repeatable(spark):
    run = new_run_dir(spark, "stream-test")
    customers(spark, [(n, str(n)) for n in range(40)]).repartition(5).write.parquet(f"{run}/in")
    schema = customers(spark).schema
    for _ in range(2):
        load_stream(read_files(spark, f"{run}/in", schema, 2), plan(), f"{run}/out", f"{run}/state")
    assert loaded(spark, f"{run}/out").count() == 40
    batches = batch_evidence(spark, f"{run}/out").collect()
    assert len(batches) == 3 and all(row.rows_read == row.rows_written for row in batches)
    # A retry that lost its progress replays the same batches over the same folders.
    load_stream(read_files(spark, f"{run}/in", schema, 2), plan(), f"{run}/out", f"{run}/state-lost")
    assert loaded(spark, f"{run}/out").count() == 40


def test_required_columns_are_enforced_by_the_writing_job(spark, database):
    source = customers(spark, [*CUSTOMERS, (None, "Nobody")])
    with pytest.raises(TransferError) as error:
        stage(source, uuid.uuid4(), database, required=["full_name", "customer_id"])
    assert error.value.reason == "NULL_IN_REQUIRED_COLUMN" and "'customer_id': 1" in str(error.value)
    assert stage(source, uuid.uuid4(), database, required=["full_name"]).rows_written == 4


def test_documents_land_with_every_digit_or_are_set_aside(spark, database):
    texts = ['{"b": 1.10, "a": 123456789012345678901234567890}', "{", '{"a":1,"a":1}', None, ' [1E+5, "1.50", "\\u0001"] ', "[NaN]"]
    source = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "id int, doc string")
    transport = uuid.uuid4()
    staged = stage(source, transport, database, json_columns=["doc"], quarantine=True)
    assert (staged.rows_read, staged.rows_written, staged.rows_rejected) == (6, 3, 3)
    assert {row.id: row.doc for row in staged.frame(spark).collect()} == {
        0: '{"a":123456789012345678901234567890,"b":1.10}', 3: None, 4: '[1E+5,"1.50","\\u0001"]',
    }
    assert {(row.code, row.raw_text) for row in spark.table(staged.rejected).collect()} == {("UNREADABLE_JSON", texts[n]) for n in (1, 2, 5)}
    with pytest.raises(TransferError) as error:
        stage(source, uuid.uuid4(), database, json_columns=["doc"])
    assert error.value.reason == "UNREADABLE_VALUES"


def test_the_load_counts_the_publish_rules(spark, database, monkeypatch):
    target = people(spark, database)
    monkeypatch.setattr("tablelift.sinks.publish.broken_rows", lambda *_, **__: pytest.fail("a pass of its own"))
    steps = load(customers(spark), plan(), target, database, uuid.uuid4())
    assert [row.status for row in steps.orderBy("step").collect()] == ["SUCCEEDED"] * 3 and spark.table(target).count() == 3
    broken = load(customers(spark, [(None, "x"), (2**40, "y")]), plan(), target, database, uuid.uuid4())
    assert [(row.stage, row.status) for row in broken.orderBy("step").collect()][1] == ("EXECUTING", "FAILED")
    assert spark.table(target).count() == 3
