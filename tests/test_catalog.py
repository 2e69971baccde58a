"""Catalog scalars, constraints, arrays and documents."""

import pytest
from pyspark.sql import functions as F

from tablelift.functions.catalog import (
    is_fixed_code, optional_bool, optional_int, optional_nullable, optional_text, pick, raw, schema_class, stripped, whole_number_of,
)
from tablelift.functions.json import canonical_json, canonical_row, fingerprint, redacted, redacted_json, richness
from tablelift.functions.types import canonical_type, decimal_digits
from tablelift.operators.arrays import array_chains
from tablelift.operators.catalog import facet_coverage, mark_membership, normalize_columns, objects, richest
from tablelift.operators.documents import scan_outcomes
from tablelift.operators.constraints import (
    accept_primary_keys, foreign_key_coverage, foreign_key_pairs, foreign_keys, key_constraints, key_coverage,
)


def one(spark, expr, **values):
    names = ", ".join(f"{'NULL' if v is None else repr(v)} AS {k}" for k, v in values.items())
    return spark.sql(f"SELECT {names}").select(expr).first()[0]


@pytest.mark.parametrize(
    "dialect,native,scale,expected",
    [
        ("postgresql", "Character  Varying (10)", None, "STRING"), ("postgresql", "numeric", 0, "INTEGER"),
        ("postgresql", "numeric(10,2)", 2, "DECIMAL"), ("postgresql", "numeric", None, "DECIMAL"),
        ("postgresql", "integer[]", None, "SEMI_STRUCTURED"), ("postgresql", "ARRAY", None, "SEMI_STRUCTURED"),
        ("postgresql", "timestamp(3) with time zone", None, "TIMESTAMP_TZ"), ("postgresql", "geometry", None, "UNKNOWN"),
        ("mysql", "bit", None, "BINARY"), ("mysql", "year", None, "INTEGER"), ("mysql", "datetime(6)", None, "TIMESTAMP"),
        ("snowflake", "timestamp_ltz", None, "TIMESTAMP_TZ"), ("snowflake", "NUMBER(38,0)", 0, "INTEGER"),
        ("snowflake", "variant", None, "SEMI_STRUCTURED"), ("snowflake", None, None, "UNKNOWN"),
        ("spark", "array<int>", None, "SEMI_STRUCTURED"), ("spark", "timestamp_ntz", None, "TIMESTAMP"),
        ("spark", "decimal(10,2)", 2, "DECIMAL"), ("spark", "interval day", None, "UNKNOWN"),
    ],
)
def test_canonical_types(spark, dialect, native, scale, expected):
    frame = spark.createDataFrame([(native, scale)], "native string, scale int")
    assert frame.select(canonical_type(dialect, F.col("native"), F.col("scale"))).first()[0] == expected


@pytest.mark.parametrize("bits,digits", [(16, 5), (32, 10), (64, 19)])
def test_binary_precision(spark, bits, digits):
    assert one(spark, decimal_digits(F.lit("INTEGER"), F.col("p"), F.lit(2)), p=bits) == digits


def test_optional_values(spark):
    texts = [(" 7 ", 7), ("+3", 3), ("12.5", None), ("", None), ("invalid", None), (None, None), ("٣", None), ("\t8\n", 8), ("\u00a09\u3000", 9), ("1e3", None), ("- 1", None)]
    for text, expected in texts:
        frame = spark.createDataFrame([(text,)], "v string")
        assert frame.select(optional_int(F.col("v"))).first()[0] == expected
    assert one(spark, optional_text(F.col("v")), v="  ") is None and one(spark, optional_text(F.col("v")), v=" a ") == " a "
    assert one(spark, optional_nullable(F.col("v")), v=" Yes") is True
    assert one(spark, optional_nullable(F.col("v")), v="UNKNOWN") is None
    assert one(spark, optional_bool(F.col("v")), v="T") is True and one(spark, optional_bool(F.col("v")), v="maybe") is None


def test_pick_takes_the_first_present_field_even_if_null(spark):
    frame = spark.sql("SELECT CAST(NULL AS STRING) AS Data_Type, 'int' AS native_type")
    assert frame.select(pick(frame, "data_type", "native_type")).first()[0] is None
    assert frame.select(pick(frame, "missing", "NATIVE_TYPE")).first()[0] == "int"


def test_invalid_catalog_values_become_null(spark):
    raw = spark.createDataFrame(
        [("t", "c", "12.5", "bogus", "UNKNOWN", "invalid", "")],
        "table_id string, COLUMN_NAME string, ordinal_position string, data_type string, is_nullable string,"
        " character_maximum_length string, numeric_precision string",
    )
    row = normalize_columns(raw, "postgresql").first()
    assert (row.ordinal_position, row.nullable, row.character_length, row.numeric_precision) == (None,) * 4
    assert row.canonical_type == "UNKNOWN" and row.column_name == "c"


def test_text_that_is_no_whole_number_is_not_cast(spark):
    texts = [
        "1", " 2", "+3", "-4", "- 5", "", "x", "12.5", "1e3", "\x005\x00", "\x7f6\x7f", "9223372036854775807", "9223372036854775808",
        "-9223372036854775808", "+", "+-1", "1_0", "\xa07", "7\n", None, "00012", "1 2", "\u0663",
    ]
    frame = spark.createDataFrame([(text,) for text in texts], "v string")
    read = frame.select(whole_number_of(raw(F.col("v"))).alias("whole"), stripped(F.col("v")).try_cast("bigint").alias("cast"))
    assert [row.whole for row in read.collect()] == [row.cast for row in read.collect()]
    # A failed cast costs an exception per value, so the form is looked at first.
    assert "RLIKE" in read.select("whole")._jdf.queryExecution().analyzed().toString()


def test_schema_prefix_order(spark):
    kinds = {
        "pg_toast_temp_1": "POSTGRESQL_TOAST_TEMPORARY", "pg_toast_9": "POSTGRESQL_TOAST", "pg_toast": "POSTGRESQL_TOAST",
        "pg_temp_3": "POSTGRESQL_TEMPORARY", "pgx": "USER", "PG_CATALOG": "USER",
    }
    for name, expected in kinds.items():
        assert one(spark, schema_class("postgresql", F.col("v")), v=name) == expected


def test_fixed_codes(spark):
    for text, valid in (("A", True), ("A_1", True), ("1A", False), ("a", False), ("A" * 65, False), ("A\n", False)):
        frame = spark.createDataFrame([(text,)], "v string")
        assert frame.select(is_fixed_code(F.col("v"))).first()[0] is valid


def test_canonical_json_and_fingerprint(spark):
    text = one(spark, canonical_json(F.col("v")), v='{ "b": [1, {"z": null, "a": "x"}], "a": 1 }')
    assert text == '{"a":1,"b":[1,{"a":"x","z":null}]}'
    assert one(spark, fingerprint(F.lit("abc")), v=1).startswith("ba7816bf")
    frame = spark.sql("SELECT 2 AS b, CAST(NULL AS STRING) AS a, 'x' AS vendor_metadata")
    assert frame.select(canonical_row(frame)).first()[0] == '{"a":null,"b":2}'


def test_redaction_drops_exact_keys_only(spark):
    frame = spark.sql("SELECT map('Pass-Word', 1, 'PASSWORD', 2, 'token_count', 3, ' api key ', 4, 'user', 5) AS m")
    assert frame.select(redacted(F.col("m"), frame.schema["m"].dataType)).first()[0] == {"Pass-Word": 1, "token_count": 3}


KEYS = (
    "table_id string, constraint_type string, constraint_id string, constraint_name string, column_name string,"
    " key_sequence int, comment string"
)


def key_rows(spark, rows):
    return spark.createDataFrame(rows, KEYS).repartition(3)


def test_keys_fold_shuffled_duplicates(spark):
    rows = [
        ("t", "p", "1", "pk", "second", 2, None), ("t", "p", "1", "pk", "first", 1, "note"),
        ("t", "p", "1", "pk", "second", 2, None), ("t", "p", "1", "pk", "late", None, None),
        ("t", "u", "2", "uq", None, 1, None),
    ]
    got = {row.constraint_id: row for row in key_constraints(key_rows(spark, rows)).collect()}
    assert got["1"].columns == ["first", "second", "late"] and got["1"].comment == "note" and got["2"].columns == []


def test_key_coverage(spark):
    rows = [
        ("whole", "p", "1", "k", "a", 1, None), ("whole", "p", "1", "k", "b", 2, None),
        ("single", "p", "2", "k", "a", None, None), ("open", "p", "3", "k", "a", 1, None),
        ("open", "p", "3", "k", "b", None, None), ("none", "p", "4", "k", None, 1, None),
    ]
    frame = key_rows(spark, rows)
    loose = {row.table_id: row.coverage for row in key_coverage(frame, "p").collect()}
    assert loose == {"whole": "COMPLETE", "single": "COMPLETE", "open": "PARTIAL", "none": "PARTIAL"}
    strict = {row.table_id: row.coverage for row in key_coverage(frame, "p", strict=True).collect()}
    assert strict == {"whole": "COMPLETE", "single": "PARTIAL", "open": "PARTIAL", "none": "PARTIAL"}
    tables = spark.createDataFrame([("whole",), ("bare",)], "table_id string")
    read = {row.table_id: row.coverage for row in facet_coverage(tables, key_coverage(frame, "p")).collect()}
    assert read == {"whole": "COMPLETE", "bare": "COMPLETE"}
    assert {row.coverage for row in facet_coverage(tables, None).collect()} == {"UNAVAILABLE"}
    capped = facet_coverage(tables, key_coverage(frame, "p"), known="PARTIAL").collect()
    assert {row.table_id: row.coverage for row in capped} == {"whole": "PARTIAL", "bare": "COMPLETE"}


def test_marks_are_three_valued(spark):
    columns = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b")], "table_id string, column_name string")
    members = spark.createDataFrame([("x", "a"), ("y", "a")], "table_id string, column_name string")
    coverage = spark.createDataFrame([("x", "COMPLETE"), ("y", "PARTIAL")], "table_id string, coverage string")
    marked = mark_membership(columns, members, coverage, "m").collect()
    assert {(row.table_id, row.column_name): row.m for row in marked} == {("x", "a"): True, ("x", "b"): False, ("y", "b"): None}


FOREIGN = (
    "table_id string, constraint_id string, constraint_name string, local_column_name string,"
    " referenced_column_name string, referenced_table string, key_sequence int, expected_column_count int"
)


def test_foreign_keys(spark):
    rows = [
        ("t", "1", "fk", "second", "id2", "r", 2, 2), ("t", "1", "fk", "first", "id1", "r", 1, 2),
        ("t", "1", "fk", "first", "id1", "r", 1, 2), ("u", "2", "fk", "a", "b", "r", 1, 1),
        ("v", "3", "fk", "a", None, "r", 1, 1),
    ]
    frame = spark.createDataFrame(rows, FOREIGN).repartition(3)
    got = {row.table_id: (row.local_columns, row.referenced_columns) for row in foreign_keys(foreign_key_pairs(frame)).collect()}
    assert got == {"t": (["first", "second"], ["id1", "id2"]), "u": (["a"], ["b"])}
    coverage = {row.table_id: row.coverage for row in foreign_key_coverage(frame).collect()}
    assert coverage == {"t": "PARTIAL", "u": "COMPLETE", "v": "PARTIAL"}


def test_primary_key_acceptance(spark):
    headers = [(name, "pk", "c") for name in ("ok", "gap", "dup", "col", "far", "note", "empty", "twice", "unlisted")]
    headers.append(("twice", "pk", None))
    members = [
        ("ok", "ok", "pk", "b", 2, None), ("ok", "ok", "pk", "a", 1, "c"),
        ("gap", "gap", "pk", "a", 1, None), ("gap", "gap", "pk", "b", 3, None),
        ("dup", "dup", "pk", "a", 1, None), ("dup", "dup", "pk", "b", 1, None),
        ("col", "col", "pk", "a", 1, None), ("col", "col", "pk", "a", 2, None),
        ("far", "elsewhere", "pk", "a", 1, None), ("note", "note", "pk", "a", 1, "changed"),
        ("twice", "twice", "pk", "a", 1, None), ("unlisted", "unlisted", "pk", "ghost", 1, None),
    ]
    known = spark.createDataFrame(
        [(name, column) for name in ("ok", "gap", "dup", "col", "far", "note", "twice") for column in "ab"],
        "table_id string, column_name string",
    )
    got = accept_primary_keys(
        spark.createDataFrame(headers, "table_id string, constraint_name string, comment string"),
        spark.createDataFrame(
            members,
            "table_id string, member_table_id string, constraint_name string, column_name string, key_sequence int,"
            " comment string",
        ),
        known,
    )
    prefix = "PRIMARY_KEY_MEMBERSHIP_"
    assert {row.table_id: (row.columns, row.warning) for row in got.collect()} == {
        "ok": (["a", "b"], None), "gap": (None, prefix + "PARTIAL"), "dup": (None, prefix + "PARTIAL"),
        "col": (None, prefix + "PARTIAL"), "far": (None, prefix + "UNMATCHED"), "note": (None, prefix + "CONFLICT"),
        "empty": (None, prefix + "UNAVAILABLE"), "twice": (None, prefix + "PARTIAL"),
        "unlisted": (None, prefix + "PARTIAL"),
    }


def test_richest_is_independent_of_order(spark):
    rows = [("a", "zeta", None), ("a", "alpha", None), ("b", None, None), ("b", None, 5)]
    for partitions in (1, 4):
        frame = spark.createDataFrame(rows, "id string, comment string, n int").repartition(partitions)
        assert sorted(tuple(row) for row in richest(frame, ["id"]).collect()) == [("a", "alpha", None), ("b", None, 5)]


def test_deep_and_circular_arrays(spark):
    depth = 300
    rows = [(f"d{n}", "ARRAY", f"d{n + 1}") for n in range(depth)] + [(f"d{depth}", "NUMBER", None)]
    rows += [("x", "ARRAY", "y"), ("y", "ARRAY", "x"), ("into", "ARRAY", "x"), ("lost", "ARRAY", "nowhere")]
    rows += [("two", "ARRAY", "a"), ("two", "ARRAY", "b"), ("plain", " Text ", "d0"), ("open", "ARRAY", "")]
    frame = spark.createDataFrame(rows, "collection_id string, data_type string, element_id string")
    got = {row.collection_id: tuple(row)[1:] for row in array_chains(frame).collect()}
    assert got["d0"] == (depth + 1, "NUMBER", False) and got["d299"] == (2, "NUMBER", False)
    assert got["x"] == got["into"] == (None, None, True) and got["lost"] == (None, None, False)
    assert "two" not in got and got["plain"] == (1, " Text ", False) and got["open"] == (1, "ARRAY", False)


def test_empty_type_filter_reads_nothing(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.lit("c").alias("catalog_name"), F.lit("s").alias("schema_name"),
        F.col("o_orderstatus").alias("object_name"), F.lit("r").alias("relkind"), F.lit(1).alias("reltuples"),
    )
    empty = objects(orders, "postgresql", [])
    assert "FileScan" not in empty._jdf.queryExecution().executedPlan().toString() and empty.count() == 0


def test_rows_without_an_id_belong_together_by_name_or_stay_alone(spark):
    rows = [
        ("t", "u", "", "uq", "b", 2, None), ("t", "u", None, "uq", "a", 1, None), ("t", "u", "", " ", "c", 1, None),
        ("t", "u", " ", None, "d", 1, None), ("t", "u", "7", "uq", "e", 1, None),
    ]
    got = sorted(row.columns for row in key_constraints(key_rows(spark, rows)).collect())
    assert got == [["a", "b"], ["c"], ["d"], ["e"]]


def test_rows_with_whole_member_lists(spark):
    schema = "table_id string, constraint_type string, constraint_id string, constraint_name string, column_names array<string>, column_name string, key_sequence int"
    rows = [
        ("list", "u", "1", "k", ["b", "a"], None, None), ("mixed", "u", "1", "k", ["b", "a"], None, None), ("mixed", "u", "1", "k", None, "z", None),
        ("empty", "u", "1", "k", [], None, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    assert {row.table_id: row.columns for row in key_constraints(frame).collect()} == {"list": ["b", "a"], "mixed": ["b", "a", "z"], "empty": []}
    coverage = {row.table_id: row.coverage for row in key_coverage(frame, "u").collect()}
    assert coverage == {"list": "COMPLETE", "mixed": "PARTIAL", "empty": "PARTIAL"}


def test_a_failed_scan_is_unavailable_only_without_privilege(spark):
    tables = spark.createDataFrame([("a",), ("b",)], "table_id string")
    outcome = "table_id string, facet string, sqlstate string"
    read = {row.table_id: (row["columns"], row["keys"]) for row in scan_outcomes(tables, spark.createDataFrame([("a", "keys", "42501")], outcome)).collect()}
    assert read == {"a": (True, False), "b": (True, True)}
    with pytest.raises(Exception, match="Scan of keys failed with state 57014"):
        scan_outcomes(tables, spark.createDataFrame([("a", "keys", "57014")], outcome)).collect()


def test_nested_values_count_and_redact(spark):
    frame = spark.sql("""SELECT array(1, NULL, 2) AS a, named_struct('token', 'x', 'm', map('k', array(named_struct('Secret', 1, 'v', NULL)))) AS s,
        parse_json('{"k":[1,null,{"z":":"}],"t":true}') AS v, CAST(NULL AS STRUCT<x: INT>) AS n""")
    assert frame.select(richness(frame)).first()[0] == 2 + 2 + 3
    kinds = {field.name: field.dataType for field in frame.schema.fields}
    cleaned = frame.select(redacted(F.col("s"), kinds["s"]).alias("s"), redacted(F.col("n"), kinds["n"]).alias("n")).first()
    assert cleaned.s.asDict(True) == {"m": {"k": [{"v": None}]}} and cleaned.n is None
    text = one(spark, redacted_json(F.col("v")), v='[{"User": 1, "n": 1.000}, "ValueError: x", {"users": [{"pwd": 2}]}]')
    assert text == '[{"n":1.000},"[REDACTED_EXCEPTION]",{"users":[{}]}]'
