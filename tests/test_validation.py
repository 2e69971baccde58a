"""Metrics, reconciliation and reports."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.operators.metrics import checks_frame, checks_of, source_metrics, target_metrics
from tablelift.operators.reconcile import count_value, reconcile, report, validate
from tablelift.queries.data import CUSTOMER_PLAN, copy_plan, customer_source
from tablelift.operators.projection import project

IDS = ["row_count", "m000_null_count", "m000_distinct_count", "m001_null_count", "m001_distinct_count"]


def values(frame):
    return {row.check_id: row.value for row in frame.collect()}


def simple(spark, rows):
    return spark.createDataFrame(rows, "a bigint, b string")


def metric_frame(spark, pairs, kind="bigint"):
    return spark.createDataFrame(pairs, f"check_id string, value {kind}")


def test_flagship_passes_and_a_lost_row_is_found(spark, sf_dir):
    source = customer_source(spark, sf_dir)
    target = project(source, CUSTOMER_PLAN)
    checked = validate(source, target, CUSTOMER_PLAN)
    assert [row.status for row in checked.collect()] == ["MATCH"] * 11
    assert report(checked, plan_version=1).first().status == "PASSED"
    short = {row.check_id: row for row in validate(source, target.filter("customer_key <> 5"), CUSTOMER_PLAN).collect()}
    assert short["row_count"].status == "MISMATCH" and short["row_count"].difference == -1


def test_report_precedence(spark):
    plan = copy_plan(simple(spark, []), "s", "t")
    checks = checks_frame(spark, checks_of(plan))
    same = metric_frame(spark, [(name, 1) for name in IDS])
    other = metric_frame(spark, [(name, 2) for name in IDS] + [("extra", 9)])
    part = metric_frame(spark, [(name, 1) for name in IDS[1:]])
    assert report(reconcile(checks, same, same), plan_version=3).first().asDict() == {
        "matched_count": 5, "mismatched_count": 0, "unavailable_count": 0, "status": "PASSED", "plan_version": 3,
    }
    failed = reconcile(checks, same, other)
    assert {row.difference for row in failed.collect()} == {1} and failed.count() == 5
    assert report(failed, plan_version=1).first().status == "FAILED"
    assert report(reconcile(checks, same, part), plan_version=1).first().status == "INCOMPLETE"
    assert report(reconcile(checks, part, other), plan_version=1).first().status == "FAILED"


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_metrics_do_not_depend_on_partitioning(spark, partitions):
    frame = simple(spark, [(n % 5, None if n % 3 else str(n)) for n in range(100)]).repartition(partitions)
    assert values(target_metrics(frame, copy_plan(frame, "s", "t"))) == dict(zip(IDS, [100, 0, 5, 66, 34]))


def test_empty_and_all_null_inputs(spark):
    empty = simple(spark, [])
    plan = copy_plan(empty, "s", "t")
    assert values(source_metrics(empty, plan)) == dict(zip(IDS, [0, None, 0, None, 0]))
    nulls = simple(spark, [(None, None)] * 4)
    assert values(source_metrics(nulls, plan)) == dict(zip(IDS, [4, 4, 0, 4, 0]))


@pytest.mark.parametrize("width", [3, 30])
def test_tables_of_any_width_take_one_scan(spark, sf_dir, width):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    frame = orders.select(*[(F.col("o_orderkey") % (n + 1)).alias(f"c{n}") for n in range(width)])
    measured = target_metrics(frame, copy_plan(frame, "s", "t"))
    whole = values(measured)
    assert [whole[f"m{n:03d}_distinct_count"] for n in range(width)] == list(range(1, width + 1))
    assert measured._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_distinct_keys_follow_grouping(spark):
    frame = spark.sql(
        "SELECT * FROM VALUES (0.0D, array(1, NULL), X'00', 1.50BD, timestamp'2020-01-01 00:00:00.000001'),"
        " (-0.0D, array(1), X'01', 1.5BD, timestamp'2020-01-01'), (double('NaN'), array(1, NULL), X'00', NULL, NULL),"
        " (double('NaN'), NULL, NULL, NULL, NULL) AS t(a, b, c, d, e)"
    )
    found = values(target_metrics(frame, copy_plan(frame, "s", "t")))
    for n, name in enumerate("abcde"):
        assert found[f"m{n:03d}_distinct_count"] == frame.select(F.countDistinct(name)).first()[0], name
        assert found[f"m{n:03d}_null_count"] == frame.filter(F.col(name).isNull()).count()


def test_approximate_checks_say_so(spark):
    frame = spark.range(1000).select(F.col("id").alias("a"))
    checked = validate(frame, frame, copy_plan(frame, "s", "t"), mode="approx")
    assert {row.check_type for row in checked.collect()} == {"ROW_COUNT", "NULL_COUNT", "APPROX_DISTINCT_COUNT"}


@pytest.mark.parametrize(
    "value,kind,expected",
    [
        ("12", "string", 12), ("+3", "string", 3), ("-1", "string", None), ("1.0", "string", None),
        ("1\n", "string", None), (5, "bigint", 5), (-5, "bigint", None), (2.0, "double", None), (True, "boolean", None),
    ],
)
def test_count_values(spark, value, kind, expected):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    assert frame.select(count_value(F.col("v"), frame.schema["v"].dataType)).first()[0] == expected


def test_decimal_counts(spark):
    frame = spark.sql("SELECT CAST(7 AS DECIMAL(10,2)) AS a, CAST(7.5 AS DECIMAL(10,2)) AS b")
    kind = T.DecimalType(10, 2)
    row = frame.select(count_value(F.col("a"), kind).alias("a"), count_value(F.col("b"), kind).alias("b")).first()
    assert (row.a, row.b) == (7, None)


def test_metric_plan_prunes_and_has_no_row_shuffle_but_for_distincts(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = copy_plan(orders.select("o_orderkey"), "s", "t")
    text = target_metrics(orders, plan)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in text
