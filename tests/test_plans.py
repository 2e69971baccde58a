"""Expression grammar, plan rules and limits."""

import math

import pytest
from pyspark.sql import types as T

from tablelift.functions.types import UnsupportedTypeError, family_of, landing_type
from tablelift.operators.projection import preview, project, unique_names
from tablelift.plans.expressions import (
    Expr, InvalidPlanError, cast, coalesce, columns_read, concat, copy_of, literal, quote, source_column, to_column,
)
from tablelift.plans.limits import Endpoint, effective_limit, page_bounds, preflight
from tablelift.plans.plan import Approval, Plan


def approved(source, target, expr, ordinal=None, data_type=None, **kw):
    return Approval(source, "APPROVED", target, data_type, ordinal, compatibility="EXACT", transformation=expr, **kw)


@pytest.mark.parametrize(
    "build",
    [
        lambda: Expr("DIRECT_COPY", ("a", "b")),
        lambda: Expr("CAST", ("a",)),
        lambda: concat("a"),
        lambda: concat("a", "a"),
        lambda: coalesce("a"),
        lambda: literal(math.inf),
        lambda: literal([1]),
        lambda: Expr("UPPER", ("a",)),
        lambda: copy_of(" "),
    ],
)
def test_malformed_expressions_are_refused(build):
    with pytest.raises(InvalidPlanError):
        build()


def test_nested_depth_is_bounded(spark):
    def nest(levels):
        expr = literal("x")
        for _ in range(levels):
            expr = coalesce("a", expr)
        return expr

    to_column(nest(15), ["a"])
    with pytest.raises(InvalidPlanError):
        to_column(nest(16), ["a"])


def test_unknown_columns_are_refused_before_spark(spark):
    with pytest.raises(InvalidPlanError):
        to_column(coalesce("a", source_column("missing")), ["a"])


def test_people_plan(spark):
    people = spark.createDataFrame(
        [("Asha", "Rao", 3), ("Neha", None, 4)], "first_name string, last_name string, age int"
    )
    plan = Plan(
        "source",
        "people",
        (
            approved("first_name", "full_name", concat("first_name", "last_name", separator=" "), 2),
            Approval("last_name"),
            approved("age", "age", copy_of("age"), 1),
        ),
    )
    got = project(people, plan)
    assert got.columns == ["age", "full_name"]
    assert [tuple(row) for row in got.collect()] == [(3, "Asha Rao"), (4, "Neha")]
    assert plan.lineage() == ("age", "first_name", "last_name") and not plan.is_complete
    assert preview(people, plan, 1).count() == 1


def test_concat_null_modes(spark):
    frame = spark.createDataFrame([("a", None)], "x string, y string")
    plan = Plan("s", "t", (approved("x", "z", concat("x", "y")), Approval("y")))
    assert project(frame, plan).first().z is None
    assert project(frame, plan, null_mode="skip").first().z == "a"


def test_coalesce_of_number_and_text_takes_the_target_type(spark):
    frame = spark.createDataFrame([(None,), (7,)], "n bigint")
    plan = Plan("s", "t", (approved("n", "z", coalesce("n", literal("none")), 1, T.StringType()),))
    assert [row.z for row in project(frame, plan).collect()] == ["none", "7"]


def test_odd_identifiers_survive(spark):
    frame = spark.createDataFrame([(1, 2)], "`a``b.c` int, `select` int")
    plan = Plan("s", "t", (approved("a`b.c", "x.y", copy_of("a`b.c")), approved("select", "from", copy_of("select"))))
    assert project(frame, plan).columns == ["from", "x.y"]
    with pytest.raises(InvalidPlanError):
        quote("a\x00b")


def test_lineage_of_nested_expressions():
    expr = coalesce("a", coalesce(source_column("b"), cast("c", "STRING")))
    assert columns_read(expr) == ("a", "b", "c") and columns_read(expr, nested=False) == ("a",)


@pytest.mark.parametrize(
    "build",
    [
        lambda: Approval("a", "REJECTED", "x"),
        lambda: Approval("a", "APPROVED"),
        lambda: Approval("a", "OVERRIDDEN", "x", override_reason="  "),
        lambda: Approval("a", "APPROVED", "x", compatibility="INCOMPATIBLE"),
        lambda: Plan("s", "t", (Approval("a"), Approval("a"))),
        lambda: Plan("s", "t", (approved("a", "x", copy_of("a")), approved("b", "x", copy_of("b")))),
        lambda: Plan("s", "t", (Approval("a"),), version=0),
        lambda: Plan("s", "t", (Approval("a"),)).mappings,
    ],
)
def test_plan_rules(build):
    with pytest.raises(InvalidPlanError):
        build()


def test_fingerprint_changes_with_the_mapping_only():
    plan = Plan("s", "t", (approved("a", "x", copy_of("a")),))
    assert plan.fingerprint() == Plan("s", "t", (approved("a", "x", copy_of("a")),)).fingerprint()
    assert plan.fingerprint() != Plan("s", "t", (approved("a", "x", cast("a", "STRING")),)).fingerprint()


def test_limits():
    assert effective_limit(None, 500) == 500 and effective_limit(20, 500) == 20 and effective_limit(900, 500) == 500
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            effective_limit(bad, 500)
    assert page_bounds(500, 0) == (500, 0)
    for limit, offset in ((0, 0), (501, 0), (10, -1)):
        with pytest.raises(ValueError):
            page_bounds(limit, offset)


def test_preflight_takes_the_smaller_limits():
    reader, writer = Endpoint("src", max_rows=400), Endpoint("dst", can_write=True, timeout_seconds=10)
    assert preflight(reader, writer, "dst", 1000, None) == (400, 10)
    with pytest.raises(PermissionError):
        preflight(reader, Endpoint("dst"), "dst", None, None)
    with pytest.raises(PermissionError):
        preflight(Endpoint("src", can_read=False), writer, "dst", None, None)
    with pytest.raises(ValueError):
        preflight(reader, writer, "other", None, None)


def test_unique_names():
    assert unique_names(["id", "id", "name", "id"]) == ["id", "id_2", "name", "id_3"]
    assert unique_names(["id", "id_2", "id"]) == ["id", "id_2", "id_3"]


def test_landing_types():
    assert landing_type("INTEGER", spark_type=T.ShortType()) == T.ShortType()
    assert landing_type("INTEGER") == T.DecimalType(38, 0)
    assert landing_type("DECIMAL", precision=10, scale=2) == T.DecimalType(10, 2)
    assert landing_type("DECIMAL", precision=60, scale=2) == T.StringType()
    assert landing_type("DECIMAL") == T.StringType()
    assert landing_type("TIMESTAMP", datetime_precision=9) == T.StringType()
    assert landing_type("TIMESTAMP_TZ", datetime_precision=6) == T.TimestampType()
    assert landing_type("TIME") == T.StringType()
    with pytest.raises(UnsupportedTypeError):
        landing_type("UNKNOWN")
    assert family_of(T.MapType(T.StringType(), T.StringType())) == "SEMI_STRUCTURED"
    assert family_of(T.DayTimeIntervalType()) == "UNKNOWN"
