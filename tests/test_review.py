"""Review rules on a small plan, and plans loaded from approvals."""

import pytest
from pyspark.sql import types as T

from tablelift.operators.review import (
    DECISION_SCHEMA, apply_decisions, approved, decision_violations, load_plan, publish_gate, review_plan, status_counts,
)
from tablelift.plans.expressions import coalesce, literal

COLUMNS = (
    "table_id string, column_name string, ordinal_position int, canonical_type string, character_length int,"
    " numeric_precision int, numeric_scale int, datetime_precision int"
)
SUGGESTIONS = (
    "source_table string, target_table string, source_column string, target_column string, confidence double,"
    " compatibility string, decision string"
)


def column(table_id, name, ordinal, kind):
    return (table_id, name, ordinal, kind, None, None, None, None)


@pytest.fixture()
def frames(spark):
    source = [column("s", "id", 1, "INTEGER"), column("s", "name", 2, "STRING"), column("s", "flag", 3, "BOOLEAN")]
    target = [column("t", "id", 1, "DECIMAL"), column("t", "name", 2, "STRING"), column("t", "note", 3, "STRING")]
    suggestions = [
        ("s", "t", "id", "id", 0.9, "SAFE", "SUGGESTED"), ("s", "t", "name", "name", 0.6, "EXACT", "SUGGESTED"),
        ("s", "t", "flag", None, 0.0, "UNKNOWN", "UNMATCHED"),
    ]
    return {
        "suggestions": spark.createDataFrame(suggestions, SUGGESTIONS),
        "source_columns": spark.createDataFrame(source, COLUMNS),
        "target_columns": spark.createDataFrame(target, COLUMNS),
    }


def decide(spark, *rows):
    return spark.createDataFrame([("s", "t", *row) for row in rows], DECISION_SCHEMA)


def violations(spark, frames, *rows):
    found = decision_violations(**frames, decisions=decide(spark, *rows)).collect()
    return {(row.source_column, row.violation) for row in found}


def test_nothing_is_approved_by_itself(frames):
    assert {row.status for row in review_plan(frames["suggestions"]).collect()} == {"PENDING"}


def test_automatic_transformations_and_gate(spark, frames):
    rows = [
        ("id", None, "APPROVED", None, None, None), ("name", None, "OVERRIDDEN", "checked", None, None),
        ("flag", None, "REJECTED", None, None, None),
    ]
    approvals = apply_decisions(**frames, decisions=decide(spark, *rows))
    got = {row.source_column: row for row in approvals.collect()}
    assert (got["id"].transformation, got["id"].compatibility, got["id"].target_ordinal_position) == ("CAST", "SAFE", 1)
    assert got["name"].transformation == "DIRECT_COPY" and got["flag"].target_column is None
    assert not any(row.violations for row in got.values()) and violations(spark, frames, *rows) == set()
    assert publish_gate(approvals).first().may_publish and approved(approvals).count() == 2
    assert status_counts(approvals).first().asDict()["rejected"] == 1
    schema = T.StructType([T.StructField("id", T.DecimalType(20, 0)), T.StructField("name", T.StringType())])
    plan = load_plan(approvals, "s", "t", schema, {"name": coalesce("name", literal("?"))}, version=2)
    assert [item.target_column for item in plan.mappings] == ["id", "name"] and plan.version == 2 and plan.is_complete


def test_pending_columns_block_publishing(spark, frames):
    approvals = apply_decisions(**frames, decisions=decide(spark, ("id", None, "APPROVED", None, None, None)))
    gate = publish_gate(approvals).first()
    assert (gate.pending, gate.may_publish) == (2, False)


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([("name", None, "APPROVED", None, None, None)], {("name", "LOW_CONFIDENCE_NEEDS_OVERRIDE")}),
        ([("name", "note", "APPROVED", None, None, None)], set()),
        ([("name", None, "OVERRIDDEN", "  ", None, None)], {("name", "OVERRIDE_NEEDS_REASON")}),
        (
            [("flag", "note", "APPROVED", None, None, None)],
            {("flag", "INCOMPATIBLE_NEEDS_OVERRIDE"), ("flag", "EXPLICIT_TRANSFORMATION_REQUIRED")},
        ),
        ([("flag", None, "APPROVED", None, None, None)], {("flag", "APPROVED_WITHOUT_TARGET")}),
        ([("id", "gone", "REJECTED", None, None, None)], {("id", "UNKNOWN_TARGET_COLUMN")}),
        ([("ghost", None, "REJECTED", None, None, None)], {("ghost", "UNKNOWN_SOURCE_COLUMN")}),
        (
            [("id", None, "APPROVED", None, "COALESCE", ["id", "ghost"])], {("id", "UNKNOWN_EXPRESSION_COLUMN")},
        ),
        (
            [("id", None, "REJECTED", None, None, None), ("id", None, "REJECTED", None, None, None)],
            {("id", "DUPLICATE_DECISION")},
        ),
        (
            [("id", "note", "OVERRIDDEN", "x", "CONCAT", None), ("name", "note", "APPROVED", None, None, None)],
            {("id", "TARGET_REUSED"), ("name", "TARGET_REUSED")},
        ),
    ],
)
def test_each_rule_has_its_code(spark, frames, rows, expected):
    assert violations(spark, frames, *rows) == expected


def test_plan_must_cover_the_table(spark, frames):
    frames["suggestions"] = frames["suggestions"].filter("source_column <> 'flag'")
    assert ("flag", "PLAN_COLUMNS_DIFFER") in violations(spark, frames, ("id", None, "REJECTED", None, None, None))
