"""CHECK constraints and whole table documents."""

import pytest

from tablelift.operators.catalog import schemas
from tablelift.operators.documents import check_constraints, is_readable_check, whole_documents

RAW = "table_id string, constraint_name string, check_clause string, convalidated string, comment string"


def test_checks_are_deduplicated_by_name_and_expression(spark):
    rows = [
        ("t", "ck", "a > 0", "t", None), ("t", "ck", "a > 0", "t", "note"), ("t", "ck", "a > 1", None, None), ("t", " ", "a > 0", "no", None),
        ("t", None, "a > 0", "no", "x"), ("t", "ck", "", "t", None), ("t", "ck", None, "t", None),
    ]
    frame = spark.createDataFrame(rows, RAW)
    kept = frame.filter(is_readable_check(frame, "postgresql"))
    got = sorted(((row.constraint_name, row.expression, row.is_validated, row.comment) for row in check_constraints(kept).collect()), key=str)
    assert got == [("ck", "a > 0", True, "note"), ("ck", "a > 1", None, None), (None, "a > 0", False, "x")]


def test_snowflake_checks_have_to_name_their_table(spark):
    names = "constraint_catalog string, constraint_schema string, constraint_table string, catalog_name string, schema_name string, object_name string"
    rows = [
        ("D", "S", "T", "D", "S", "T", "ck", "a > 0"), ("D", "S", "U", "D", "S", "T", "ck", "a > 0"), ("D", "S", "T", "D", "S", "T", "", "a > 0"),
        ("D", "S", "T", "D", "S", "T", "c\x00", "a > 0"), ("D", "S", "T", "D", "S", "T", "ck", " \t"), ("D", "S", "T", "D", "S", "T", None, "a"),
    ]
    frame = spark.createDataFrame(rows, f"{names}, constraint_name string, expression string")
    assert [row[0] for row in frame.select(is_readable_check(frame, "snowflake")).collect()] == [True, False, False, False, False, False]


def parts(spark):
    """Frames of two tables: a, of which everything was read, and v, a view whose keys may not be read."""
    coverage = "table_id string, coverage string"
    return {
        "tables": spark.createDataFrame([("a", "TABLE"), ("v", "VIEW")], "table_id string, object_type string"),
        "outcomes": spark.createDataFrame([("v", "keys", "42501")], "table_id string, facet string, sqlstate string"),
        "columns": spark.createDataFrame([("a", "y", 2), ("a", "x", 1), ("v", "x", 1), ("a", "z", None)], "table_id string, column_name string, ordinal_position int"),
        "column_coverage": spark.createDataFrame([("a", "PARTIAL")], coverage),
        "keys": spark.createDataFrame(
            [("a", "p", "pk", ["x"]), ("a", "u", None, ["y"]), ("a", "u", "uq", ["x", "y"]), ("v", "p", "pk", ["x"])],
            "table_id string, constraint_type string, constraint_name string, columns array<string>",
        ),
        "primary_coverage": spark.createDataFrame([("a", "COMPLETE")], coverage),
        "unique_coverage": spark.createDataFrame([("a", "PARTIAL")], coverage),
        "foreign": spark.createDataFrame([], "table_id string, constraint_name string, local_columns array<string>, referenced_columns array<string>"),
        "foreign_coverage": spark.createDataFrame([], coverage),
        "checks": spark.createDataFrame([("a", None, "x > 0"), ("a", "ck", "y > 0")], "table_id string, constraint_name string, expression string"),
        "check_coverage": spark.createDataFrame([], coverage),
        "views": spark.createDataFrame([("v", "SELECT 1")], "table_id string, view_definition string"),
        "partitions": spark.createDataFrame([("a", False, None, "COMPLETE")], "table_id string, is_partitioned boolean, partitioning_expression string, coverage string"),
    }


def test_documents_hold_what_was_read_and_say_what_was_not(spark):
    got = {row.table_id: row for row in whole_documents(**parts(spark)).collect()}
    a, v = got["a"], got["v"]
    marks = [(item.column_name, item.is_primary_key, item.is_unique_key, item.is_foreign_key) for item in a.columns]
    assert marks == [("x", True, True, False), ("y", False, True, False), ("z", False, None, False)]
    assert a.primary_key.columns == ["x"] and [item.constraint_name for item in a.unique_constraints] == ["uq", None]
    assert [item.expression for item in a.check_constraints] == ["y > 0", "x > 0"] and a.view_definition is None and a.is_partitioned is False
    assert a.warnings == ["COLUMNS_PARTIAL", "UNIQUE_CONSTRAINTS_PARTIAL"] and a.coverage.partitioning == "COMPLETE"
    assert v.primary_key is None and v.columns[0].is_primary_key is None and v.coverage.primary_key == "UNAVAILABLE"
    assert v.view_definition == "SELECT 1" and v.coverage.estimated_row_count == "NOT_APPLICABLE" and v.warnings == ["KEY_CONSTRAINTS_UNAVAILABLE"]


def test_two_base_rows_of_one_table_fail(spark):
    frames = parts(spark)
    frames["tables"] = frames["tables"].unionByName(frames["tables"].filter("table_id = 'a'"))
    with pytest.raises(Exception, match="Several base rows for table a"):
        whole_documents(**frames).collect()


def test_schemas_that_hold_their_owner(spark):
    frame = spark.createDataFrame([("D", "S", "me"), ("D", "INFORMATION_SCHEMA", " ")], "catalog_name string, schema_name string, schema_owner string")
    got = sorted((row.schema_name, row.owner, row.is_system_managed) for row in schemas(frame, None, "snowflake").collect())
    assert got == [("INFORMATION_SCHEMA", None, True), ("S", "me", False)]
