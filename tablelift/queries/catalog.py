"""Catalog normalization queries over raw catalog rows derived from the test tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablelift.functions.catalog import clustering_coverage, decode, is_fixed_code, view_coverage
from tablelift.functions.json import canonical_json, redacted, redacted_json
from tablelift.functions.types import NATIVE_TYPES, WHITE_SPACE
from tablelift.operators.arrays import array_chains
from tablelift.operators.catalog import (
    base_tables,
    default_facets,
    facet_coverage,
    facet_coverages,
    is_readable_column,
    live_columns,
    mark_membership,
    normalize_catalogs,
    normalize_columns,
    objects,
    partitions,
    quarantine,
    richest,
    schemas,
    user_databases,
    warnings,
)
from tablelift.operators.constraints import (
    accept_primary_keys,
    foreign_key_coverage,
    foreign_key_membership,
    foreign_key_pairs,
    foreign_keys,
    key_constraints,
    key_coverage,
    referenced_keys,
    zip_columns,
)
from tablelift.operators.documents import check_constraints, is_readable_check, whole_documents
from tablelift.queries.catalogs import on_duckdb, on_spark
from tablelift.queries.data import table
from tablelift.session import materialize, small_methods


def pick_by(value: str, items: list[str | None]) -> str:
    """SQL CASE that picks one of ``items`` by number."""
    # Tabs and line breaks stand in the literal as they are, which both engines read alike.
    literals = ["NULL" if item is None else f"'{item}'" for item in items]
    branches = " ".join(f"WHEN {n} THEN {item}" for n, item in enumerate(literals))
    return f"CASE {value} % {len(items)} {branches} END"


_TYPES = [
    "VARCHAR(20)", " character  varying (10)", "int4", "BIGINT", "numeric(10,2)", "decimal", "double precision",
    "Float8", "bool", "boolean", "date", "time without time zone", "timestamp with time zone", "timestamp(3)",
    "timestamp_ltz", "bytea", "jsonb", "integer[]", "ARRAY", "variant", "bit", "year", "mediumint", "number",
    "fixed", "geometry", "   ", "datetime", "tinytext", "money", None, "\tVARCHAR\t(30)\n", "double\tprecision",
    "timestamp \t with\ntime zone", "\n\t", "NUMERIC\t( 10, 0 )\t",
]

RAW_COLUMNS_SQL = f"""
    SELECT concat('t', l_orderkey) AS table_id,
           CASE l_suppkey % 3 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' ELSE 'snowflake' END AS dialect,
           {pick_by("l_suppkey", ["main", " ", None])} AS table_catalog,
           {pick_by("l_suppkey", ["public", "Sales ", None, ""])} AS schema_name,
           {pick_by("l_linenumber", ["a", "b", " ", "Amount", "d d", "\t", " g\n"])} AS column_name,
           {pick_by("l_partkey", ["1", " 2 ", "+3", "12.5", "", "0", "x", None, "\t4\n", "- 5", "1e3"])} AS ordinal_position,
           {pick_by("l_partkey", _TYPES)} AS data_type,
           {pick_by("l_linenumber", ["YES", "no", "UNKNOWN", None, "\tYes\n", " No\t"])} AS is_nullable,
           {pick_by("l_suppkey", ["20", "invalid", None, "\n30\t"])} AS character_maximum_length,
           {pick_by("l_partkey + l_linenumber", ["16", "32", "64", "0", "", None])} AS numeric_precision,
           {pick_by("l_linenumber", ["2", "10"])} AS numeric_precision_radix,
           {pick_by("l_linenumber", ["0", "2", None, "+0", "1.5", "\t0"])} AS numeric_scale,
           {pick_by("l_suppkey", ["6", None])} AS datetime_precision,
           {pick_by("l_partkey", ["nextval(seq)", " ", "42", None, "\n"])} AS column_default,
           {pick_by("l_suppkey", ["a note", "\t", None])} AS column_comment,
           {pick_by("l_partkey", ["C", " de_DE ", "", None])} AS collation_name,
           {pick_by("l_linenumber", ["YES", "f", "1", "maybe", None, "\tY\n"])} AS is_identity,
           {pick_by("l_partkey", ["ALWAYS", "BY DEFAULT", " ", None])} AS identity_generation,
           {pick_by("l_partkey", ["auto_increment", "VIRTUAL GENERATED", "", None])} AS extra,
           {pick_by("l_suppkey", ["ALWAYS", "never", "virtual", "COLUMN", "stored", "", None, "\tAlways "])} AS is_generated,
           {pick_by("l_suppkey", ["a + b", "  ", None])} AS generated_expression,
           {pick_by("l_linenumber", ["t", "no", "", None])} AS is_primary_key,
           {pick_by("l_partkey", ["0", "\tTRUE", "perhaps"])} AS is_foreign_key,
           {pick_by("l_suppkey", ["n", "Yes", None])} AS unique_key,
           {pick_by("l_partkey", ["decimal", "Uuid", "real", None, "array", "bogus", "\tdouble  precision\n", " "])} AS element_native_type,
           {pick_by("l_linenumber", [" decimal", "nothing", None, "\tDate\n"])} AS element_canonical_type
    FROM {{lineitem}}
"""

KEY_ROWS_SQL = f"""
    SELECT concat('t', l_orderkey) AS table_id, CASE l_returnflag WHEN 'A' THEN 'p' ELSE 'u' END AS constraint_type,
           CASE WHEN l_partkey % 97 = 0 THEN '' WHEN l_partkey % 89 = 0 THEN NULL
                ELSE concat('t', l_orderkey, l_returnflag) END AS constraint_id,
           CASE WHEN (l_partkey % 97 = 0 OR l_partkey % 89 = 0) AND l_linenumber % 2 = 0 THEN ' '
                ELSE concat('k', l_returnflag) END AS constraint_name,
           CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE concat('c', l_partkey % 5) END AS column_name,
           CASE WHEN l_partkey % 29 = 0 THEN {{array}}(concat('c', l_partkey % 5), concat('c', l_linenumber % 3)) END
               AS column_names,
           CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE l_linenumber END AS key_sequence,
           {pick_by("l_partkey", ["note 1", "note 2", None])} AS comment,
           {pick_by("l_suppkey", ["yes", None])} AS is_validated
    FROM {{lineitem}}
"""

FOREIGN_ROWS_SQL = """
    SELECT concat('t', l_orderkey) AS table_id,
           CASE WHEN l_partkey % 89 = 0 THEN ' ' ELSE concat('t', l_orderkey, l_linestatus) END AS constraint_id,
           CASE WHEN l_partkey % 89 = 0 AND l_linenumber % 2 = 0 THEN '' ELSE concat('fk_', l_linestatus) END
               AS constraint_name,
           CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE concat('c', l_partkey % 7) END AS local_column_name,
           concat('r', l_partkey % 7) AS referenced_column_name,
           CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE concat('dim', l_linestatus) END AS referenced_table,
           l_linenumber % 2 + 1 AS key_sequence,
           CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 2 END AS expected_column_count
    FROM {lineitem}
"""

# As above with places that are missing, and rows that hold both sides as lists, some of unequal length.
FRAGMENTS_SQL = """
    SELECT table_id, constraint_id, constraint_name, local_column_name, referenced_column_name, referenced_table,
           CASE WHEN place = 7 THEN NULL ELSE key_sequence END AS key_sequence,
           CASE WHEN place = 3 THEN {array}('c1', 'c2') WHEN place = 4 THEN {array}('c1', 'c3') END AS local_columns,
           CASE WHEN place = 3 THEN {array}('r1', 'r2') WHEN place = 4 THEN {array}('r1') END AS foreign_column_names
    FROM (SELECT *, CAST(length(table_id) + 3 * key_sequence + 5 * expected_column_count
                         + coalesce(CAST(substring(local_column_name, 2, 1) AS INT), 0) AS INT) % 11 AS place
          FROM (""" + FOREIGN_ROWS_SQL + """) AS r) AS p
"""

HEADERS_SQL = """
    SELECT concat('t', o_orderkey) AS table_id, 'pk' AS constraint_name,
           CASE WHEN o_orderkey % 2 = 0 THEN 'main' END AS comment
    FROM {orders}
    UNION ALL
    SELECT concat('t', o_orderkey), 'pk', NULL FROM {orders} WHERE o_orderkey % 53 = 0
"""

MEMBERS_SQL = """
    SELECT concat('t', l_orderkey) AS table_id,
           CASE WHEN l_orderkey % 31 = 0 THEN 'elsewhere' ELSE concat('t', l_orderkey) END AS member_table_id,
           CASE WHEN l_orderkey % 37 = 0 THEN 'other' ELSE 'pk' END AS constraint_name,
           CASE WHEN l_orderkey % 11 = 0 THEN 'c1' WHEN l_orderkey % 43 = 0 THEN '' ELSE concat('c', place) END
               AS column_name,
           CASE WHEN l_orderkey % 7 = 0 THEN l_linenumber ELSE place END AS key_sequence,
           CASE WHEN l_orderkey % 29 = 0 THEN 'changed' WHEN l_orderkey % 4 = 0 THEN 'main' END AS comment
    FROM (
        SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (
            PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS place
        FROM {lineitem}
    ) AS placed
"""

ELEMENTS_SQL = """
    SELECT concat('a', o_orderkey) AS collection_id, CASE WHEN o_orderkey % 5 = 0 THEN 'NUMBER' ELSE ' Array' END
               AS data_type,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 101 = 7 THEN concat('a', o_orderkey)
                WHEN o_orderkey % 101 = 9 THEN concat('a', o_orderkey - 1)
                WHEN o_orderkey % 101 = 8 THEN concat('a', o_orderkey + 1)
                WHEN o_orderkey % 7 = 0 THEN concat('a', o_orderkey - 1)
                ELSE concat('a', CAST(floor(o_orderkey / 2) AS BIGINT)) END AS element_id
    FROM {orders}
    UNION ALL
    SELECT concat('a', o_orderkey), 'TEXT', NULL FROM {orders} WHERE o_orderkey % 61 = 0
    UNION ALL
    SELECT '', 'TEXT', NULL FROM {orders} WHERE o_orderkey % 67 = 0
"""

NAMESPACES_SQL = f"""
    SELECT 'main' AS catalog_name,
           concat({pick_by("c_custkey", ["pg_catalog", "information_schema", "pg_toast", "pg_toast_", "pg_toast_temp_",
                                         "pg_temp_", "public", "INFORMATION_SCHEMA"])},
                  CASE WHEN c_custkey % 8 IN (3, 4, 5) THEN CAST(c_custkey AS {{text}}) ELSE '' END) AS schema_name,
           c_nationkey AS owner_id
    FROM {{customer}}
"""

PG_OBJECTS_SQL = f"""
    SELECT 'main' AS catalog_name, 'public' AS schema_name, concat('o', o_custkey) AS object_name,
           {pick_by("o_orderkey", ["r", "p", "v", "m", "f", "x", " R ", None])} AS relkind,
           {pick_by("o_custkey", ["p", "u", "T", "?", None])} AS relpersistence,
           {pick_by("o_orderkey", [" ", "owner", None])} AS owner,
           CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE floor(o_totalprice) END AS reltuples
    FROM {{orders}}
"""

SF_OBJECTS_SQL = f"""
    SELECT 'main' AS catalog_name, 'PUBLIC' AS schema_name, concat('o', o_custkey) AS object_name,
           {pick_by("o_orderkey", ["BASE TABLE", "view", "MATERIALIZED VIEW", "EXTERNAL TABLE", "TEMPORARY TABLE",
                                   "stream"])} AS table_type,
           {pick_by("o_custkey", ["YES", "NO", "no", "false", None])} AS is_dynamic,
           {pick_by("o_custkey", ["NO", "NO", "yes", None])} AS is_temporary,
           {pick_by("o_custkey", ["NO", "YES", "no"])} AS is_transient,
           CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE floor(o_totalprice) END AS row_count
    FROM {{orders}}
"""

CLASSES_SQL = f"SELECT o_orderkey AS relation_id, {pick_by('o_orderkey', ['p', 'r', 'r', 'v'])} AS relkind FROM {{orders}}"
INHERITS_SQL = """
    SELECT o_orderkey AS child_id, o_orderkey - 1 AS parent_id, concat('IN (', o_custkey, ')') AS partition_bound
    FROM {orders} WHERE o_orderkey % 4 = 1
"""
STRATEGIES_SQL = f"""
    SELECT o_orderkey AS strategy_id, {pick_by("o_custkey", ["h", "l", "r", "x"])} AS partstrat,
           concat('KEY (', o_orderpriority, ')') AS partition_key
    FROM {{orders}} WHERE o_orderkey % 4 = 0
"""

ATTRIBUTES_SQL = """
    SELECT l_orderkey AS relation_id, l_linenumber - 1 AS attnum, min(l_suppkey) % 3 AS collation_id,
           max(l_returnflag) = 'R' AS attisdropped
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""
DEFAULTS_SQL = """
    SELECT l_orderkey AS relation_id, l_linenumber - 1 AS attnum, concat('d', max(l_partkey)) AS default_expression
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING max(l_partkey) % 2 = 0
"""

DUPLICATES_SQL = f"""
    SELECT concat('t', l_orderkey) AS table_id, concat('c', l_linenumber) AS column_name,
           {pick_by("l_partkey", ["zeta", "alpha", None])} AS comment,
           {pick_by("l_suppkey", ["1", "2", None, None])} AS default_expression,
           {{array}}({pick_by("l_partkey", ["a", None])}, {pick_by("l_suppkey", ["b", "c", None])}, NULL) AS tags,
           {{struct}}({pick_by("l_suppkey + l_partkey", ["x", None])} AS kind, {{array}}({pick_by("l_partkey", ["m", "n", None])}) AS parts) AS facts
    FROM {{lineitem}}
"""


CHECKS_SQL = f"""
    SELECT concat('t', l_orderkey) AS table_id, {pick_by("l_linenumber", ["ck_a", "ck_b", None, " "])} AS constraint_name,
           CASE WHEN l_partkey % 31 = 0 THEN '' WHEN l_partkey % 37 = 0 THEN NULL
                ELSE concat('c > ', l_partkey % 3) END AS check_clause,
           {pick_by("l_suppkey", ["t", "no", None])} AS convalidated,
           {pick_by("l_partkey", ["note", " ", None])} AS comment
    FROM {{lineitem}}
"""

TABLES_SQL = f"""
    SELECT concat('t', o_orderkey) AS table_id, 'main' AS catalog_name, 'public' AS schema_name,
           concat('o', o_orderkey) AS object_name,
           {pick_by("o_orderkey", ["TABLE", "VIEW", "PARTITIONED_TABLE", "MATERIALIZED_VIEW", "FOREIGN_TABLE"])} AS object_type,
           {pick_by("o_custkey", ["owner", None])} AS owner, {pick_by("o_custkey", ["about", None, None])} AS comment,
           CASE WHEN o_custkey % 6 <> 0 THEN o_custkey END AS estimated_row_count
    FROM {{orders}}
"""

_FACETS = ["columns", "keys", "foreign_keys", "check_constraints", "view_definition", "partitioning"]
OUTCOMES_SQL = f"""
    SELECT concat('t', o_orderkey) AS table_id, {pick_by("o_orderkey", _FACETS)} AS facet, '42501' AS sqlstate
    FROM {{orders}} WHERE o_custkey % 7 = 0
    UNION ALL
    SELECT concat('t', o_orderkey), {pick_by("o_custkey", _FACETS)}, '42501' FROM {{orders}} WHERE o_custkey % 11 = 0
"""

VIEWS_SQL = "SELECT concat('t', o_orderkey) AS table_id, concat('SELECT ', o_orderkey) AS view_definition FROM {orders} WHERE o_custkey % 3 <> 0"

PARTITIONS_SQL = f"""
    SELECT concat('t', o_orderkey) AS table_id, o_custkey % 2 = 0 AS is_partitioned,
           {pick_by("o_custkey", ["HASH (a)", None])} AS partitioning_expression,
           {pick_by("o_orderkey", ["COMPLETE", "PARTIAL", "COMPLETE"])} AS coverage
    FROM {{orders}} WHERE o_custkey % 4 <> 1
"""


def raw_columns(spark, sf_dir, dialect=None):
    rows = on_spark(spark, sf_dir, RAW_COLUMNS_SQL)
    return rows if dialect is None else rows.filter(F.col("dialect") == dialect).drop("dialect")


def normalized(spark, sf_dir):
    """Raw rows of three dialects as one canonical frame."""
    small_methods(spark)
    return normalize_catalogs(raw_columns(spark, sf_dir))


def native_type_counts(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy("system", "native_type", "canonical_type").agg(
        F.count(F.lit(1)).alias("columns")
    )


def quarantined(spark, sf_dir):
    """Tables whose column rows are all readable, or only partly."""
    kept, coverage = quarantine(normalized(spark, sf_dir), is_readable_column(), "COLUMNS_PARTIAL")
    counts = kept.groupBy("table_id").agg(F.count(F.lit(1)).alias("kept_columns"))
    return coverage.join(counts, "table_id", "left").select(
        "table_id", "coverage", F.coalesce("kept_columns", F.lit(0)).alias("kept_columns")
    )


def key_rows(spark, sf_dir):
    return on_spark(spark, sf_dir, KEY_ROWS_SQL.replace("{array}", "array"))


def fragments(spark, sf_dir):
    return on_spark(spark, sf_dir, FRAGMENTS_SQL.replace("{array}", "array"))


def keys(spark, sf_dir):
    return key_constraints(key_rows(spark, sf_dir)).withColumn("columns", F.array_join("columns", "|"))


FACETS = ("primary_key", "unique_constraints", "foreign_keys", "check_constraints")


def deduplicated(spark, sf_dir):
    """Copies of column rows with nested metadata: the one with most values at any depth stays."""
    rows = on_spark(spark, sf_dir, DUPLICATES_SQL.replace("{array}", "array").replace("{struct}", "struct"))
    kept = richest(rows, ["table_id", "column_name"])
    return kept.withColumns({name: F.to_json(name, {"ignoreNullFields": "false"}) for name in ("tags", "facts")})


def table_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), "o_orderkey").alias("table_id"))


def coverage(spark, sf_dir):
    """Coverage of four facets of every table; checks were never read."""
    rows, foreign = key_rows(spark, sf_dir), on_spark(spark, sf_dir, FOREIGN_ROWS_SQL)
    read = (key_coverage(rows, "p", strict=True), key_coverage(rows, "u"), foreign_key_coverage(foreign), None)
    return facet_coverages(table_ids(spark, sf_dir), dict(zip(FACETS, read)))


def warning_codes(spark, sf_dir):
    """Sorted warnings of every table with an incomplete facet."""
    long = coverage(spark, sf_dir).unpivot("table_id", list(FACETS), "facet", "coverage")
    code = F.when(F.col("coverage") != "COMPLETE", F.concat(F.upper("facet"), F.lit("_"), F.col("coverage")))
    joined = warnings(long.withColumn("warning", code))
    return joined.select(
        "table_id",
        F.array_join("warnings", ",").alias("warnings"),
        F.forall("warnings", is_fixed_code).alias("codes_valid"),
    )


def marks(spark, sf_dir):
    """Primary-key membership of the columns c0 to c4 of every table."""
    rows = key_rows(spark, sf_dir)
    columns = table_ids(spark, sf_dir).select(
        "table_id", F.explode(F.array(*[F.lit(f"c{n}") for n in range(5)])).alias("column_name")
    )
    primary = facet_coverage(table_ids(spark, sf_dir), key_coverage(rows, "p", strict=True))
    members = key_constraints(rows.filter("constraint_type = 'p'")).select("table_id", F.explode("columns").alias("column_name"))
    return mark_membership(columns, members, primary, "is_primary_key")


def accepted(spark, sf_dir):
    result = accept_primary_keys(on_spark(spark, sf_dir, HEADERS_SQL), on_spark(spark, sf_dir, MEMBERS_SQL))
    return result.withColumn("columns", F.array_join("columns", "|"))


def foreign(spark, sf_dir):
    """Foreign keys of complete pairs only."""
    result = foreign_keys(foreign_key_pairs(on_spark(spark, sf_dir, FOREIGN_ROWS_SQL)))
    return result.withColumns(
        {name: F.array_join(name, "|") for name in ("local_columns", "referenced_columns")}
    )


def zipped(spark, sf_dir):
    """Whole foreign keys unnested again; where one side knows fewer columns, partners are missing."""
    keys = ("table_id", "constraint_id", "constraint_name")
    return zip_columns(foreign_keys(fragments(spark, sf_dir)), keys)


def references(spark, sf_dir):
    """Every third order's foreign key, followed to the key it points at; some rules point nowhere."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    table_id = F.concat(F.lit("t"), key).alias("table_id")
    constraints = orders.select(F.concat(F.lit("pk"), key).alias("constraint_name"), table_id,
                                F.lit("PRIMARY KEY").alias("constraint_type")).unionByName(
        orders.select(F.concat(F.lit("fk"), key).alias("constraint_name"), table_id,
                      F.lit("FOREIGN KEY").alias("constraint_type"))
    )
    rules = orders.filter(key % 3 == 0).select(
        F.concat(F.lit("fk"), key).alias("constraint_name"), F.concat(F.lit("pk"), key * 2).alias("referenced_constraint")
    )
    return referenced_keys(rules, constraints)


def schema_classes(spark, sf_dir):
    namespaces = on_spark(spark, sf_dir, NAMESPACES_SQL.replace("{text}", "STRING"))
    roles = table(spark, sf_dir, "nation").filter("n_nationkey <> 3").select(
        F.col("n_nationkey").alias("owner_id"), F.col("n_name").alias("owner")
    )
    return schemas(namespaces, roles, "postgresql")


def owned_schemas(spark, sf_dir):
    """Schemas of a server that lists the owner with each."""
    names = F.when(F.col("c_custkey") % 50 == 0, "INFORMATION_SCHEMA").otherwise(F.col("c_name"))
    owner = F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.lit("DB").alias("catalog_name"), names.alias("schema_name"), owner.alias("schema_owner"))
    return schemas(rows, None, "snowflake")


def partition_facts(spark, sf_dir, has_helpers):
    return partitions(
        on_spark(spark, sf_dir, CLASSES_SQL),
        on_spark(spark, sf_dir, INHERITS_SQL),
        on_spark(spark, sf_dir, STRATEGIES_SQL),
        has_helpers,
    )


def live(spark, sf_dir):
    collations = table(spark, sf_dir, "region").filter("r_regionkey < 2").select(
        F.col("r_regionkey").cast("bigint").alias("collation_id"), F.col("r_name").alias("collation")
    )
    return live_columns(
        on_spark(spark, sf_dir, ATTRIBUTES_SQL), on_spark(spark, sf_dir, DEFAULTS_SQL), collations
    ).drop("attisdropped")


def facets(spark, sf_dir):
    """View and clustering coverage, and decoded rule codes, per order."""
    orders = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "VIEW").when(F.col("o_orderkey") % 4 == 1, "MATERIALIZED_VIEW")
    kind = kind.otherwise("TABLE")
    definition = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("SELECT "), "o_orderkey"))
    secure = F.col("o_custkey") % 5 == 0
    clustering = F.when(F.col("o_custkey") % 4 == 0, "YES").when(F.col("o_custkey") % 4 == 1, "maybe")
    code = F.substring(F.lower("o_orderstatus"), 1, 1)
    return orders.select(
        "o_orderkey",
        view_coverage("snowflake", kind, definition, secure).alias("snowflake_view"),
        view_coverage("postgresql", kind, definition, secure).alias("postgresql_view"),
        clustering_coverage(kind, clustering).alias("clustering"),
        decode("match_option", code).alias("match_option"),
        decode("rule", F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("c")).alias("delete_rule"),
        decode("generation_kind", F.when(F.col("o_custkey") % 2 == 0, "s")).alias("generation_kind"),
    )


def redaction(spark, sf_dir):
    """Metadata without sensitive keys at any depth: typed, and as a JSON document of unknown shape."""
    options = F.create_map(
        F.lit("Password"), F.lit("1"), F.lit("API-Key"), F.lit("2"), F.lit("token_count"), F.lit("3"),
        F.lit(" User  Name "), F.lit("4"), F.concat(F.lit("raw__driver "), "event_type"), F.lit("5"),
        F.concat(F.lit("k"), "user_id"), F.lit("6"),
    )
    endpoint = F.struct(F.lit("db").alias("HostName"), F.col("user_id").alias("port"))
    login = F.struct(F.lit("me").alias("user"), F.lit("x").alias("access-token"))
    note = F.when(F.col("event_type") == "error", "pkg.LoadError: no such table").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(options.alias("options"), F.array(endpoint, endpoint).alias("endpoints"), login.alias("login"), note.alias("note")).alias("metadata"),
        F.concat(
            F.lit('{"list":[{"user":"x","v":[{"token":1,"keep":'), "event_id", F.lit('}]},["a",{"Secret":{"z":1}}]],'),
            F.lit('"err":"Traceback (most recent call last): x","a":{"PWD":"p","n":12345678901234567890.10,"m":1e5,"ok":"tokens"}}'),
        ).alias("document"),
    )
    kind = rows.schema["metadata"].dataType
    cleaned = rows.select("event_id", redacted(F.col("metadata"), kind).alias("metadata"), redacted_json(F.col("document")).alias("document"))
    return cleaned.withColumn("metadata", canonical_json(F.col("metadata"), cleaned.schema["metadata"].dataType))


def checks(spark, sf_dir):
    """Readable CHECK rows as constraints, and the coverage of the facet per table."""
    rows = on_spark(spark, sf_dir, CHECKS_SQL)
    kept, coverage = quarantine(rows, is_readable_check(rows, "postgresql"), "CHECK_CONSTRAINTS_PARTIAL")
    return check_constraints(kept), coverage


def documents(spark, sf_dir):
    """Whole nested documents of all tables as canonical JSON. Facets are written once, as a discovery would land them."""
    columns, column_coverage = quarantine(materialize(normalized(spark, sf_dir), "columns"), is_readable_column(), "COLUMNS_PARTIAL")
    rows = materialize(key_rows(spark, sf_dir), "key-rows")
    foreign_rows = on_spark(spark, sf_dir, FOREIGN_ROWS_SQL)
    constraints, check_coverage = checks(spark, sf_dir)
    foreign = foreign_keys(foreign_key_pairs(foreign_rows))
    facets = {
        "columns": richest(columns, ["table_id", "column_name", "ordinal_position"]),
        "column_coverage": column_coverage,
        "keys": richest(key_constraints(rows), ["table_id", "constraint_type", "constraint_name", "columns"]),
        "primary_coverage": key_coverage(rows, "p", strict=True),
        "unique_coverage": key_coverage(rows, "u"),
        "foreign": richest(foreign, ["table_id", "constraint_name", "local_columns", "referenced_table", "referenced_columns"]),
        "foreign_coverage": foreign_key_coverage(foreign_rows),
        "checks": constraints,
        "check_coverage": check_coverage,
    }
    built = whole_documents(
        on_spark(spark, sf_dir, TABLES_SQL),
        on_spark(spark, sf_dir, OUTCOMES_SQL),
        **{name: materialize(frame, f"facet-{name}") for name, frame in facets.items()},
        views=on_spark(spark, sf_dir, VIEWS_SQL),
        partitions=on_spark(spark, sf_dir, PARTITIONS_SQL),
    )
    fields = F.struct(*[name for name in built.columns if name != "table_id"])
    rendered = built.select("table_id", fields.alias("document"))
    return rendered.withColumn("document", canonical_json(F.col("document"), rendered.schema["document"].dataType))


def presence_facets(spark, sf_dir):
    """Facets by presence alone: keys read, checks not, comments there, partitioning not."""
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), "o_orderkey").alias("table_id"),
        F.lit(None).cast("string").alias("Comment"),
        F.col("o_totalprice").alias("reltuples"),
        F.lit("SELECT 1").alias("view_definition"),
        "o_orderstatus",
    )
    kind = F.when(F.col("o_orderstatus") == "P", "VIEW").otherwise("TABLE")
    results = {"primary_key": key_rows(spark, sf_dir), "check_constraints": None}
    return default_facets(rows, kind, results)


def listed_databases(spark, sf_dir):
    """Databases named after customers, with server databases and templates mixed in."""
    names = F.when(F.col("c_custkey") % 50 == 0, "MySQL").when(F.col("c_custkey") % 50 == 1, "sys").otherwise(F.col("c_name"))
    return user_databases(table(spark, sf_dir, "customer").select(names.alias("name")), "mysql")


def listed_tables(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "VIEW").otherwise("base table")
    schema = F.when(F.col("o_custkey") % 2 == 0, "public").otherwise("Public")
    rows = table(spark, sf_dir, "orders").select(
        schema.alias("schema_name"), kind.alias("table_type"), F.concat(F.lit("t"), "o_orderkey").alias("table_name")
    )
    return base_tables(rows, "public")


QUERIES = {
    "normalize_columns": normalized,
    "normalize_native_types": native_type_counts,
    "column_quarantine": quarantined,
    "key_membership": keys,
    "fk_pairs": lambda spark, sf: foreign_key_pairs(on_spark(spark, sf, FOREIGN_ROWS_SQL)),
    "fk_membership": foreign,
    "fk_unnested": zipped,
    "fk_membership_coverage": lambda spark, sf: foreign_key_membership(fragments(spark, sf)),
    "fk_references": references,
    "constraint_coverage": coverage,
    "table_warnings": warning_codes,
    "default_facets": presence_facets,
    "membership_marks": marks,
    "richness_dedup": deduplicated,
    "pk_acceptance": accepted,
    "array_chain": lambda spark, sf: array_chains(on_spark(spark, sf, ELEMENTS_SQL)),
    "schema_classes": schema_classes,
    "owned_schemas": owned_schemas,
    "object_types": lambda spark, sf: objects(on_spark(spark, sf, PG_OBJECTS_SQL), "postgresql"),
    "object_types_filtered": lambda spark, sf: objects(
        on_spark(spark, sf, SF_OBJECTS_SQL), "snowflake", ["TABLE", "DYNAMIC_TABLE", "VIEW"]
    ),
    "partition_facts": lambda spark, sf: partition_facts(spark, sf, True),
    "partition_facts_without_helpers": lambda spark, sf: partition_facts(spark, sf, False),
    "live_columns": live,
    "object_facets": facets,
    "redacted_metadata": redaction,
    "check_constraints": lambda spark, sf: checks(spark, sf)[0],
    "table_documents": documents,
    "user_databases": listed_databases,
    "base_tables": listed_tables,
}


def _bare(value: str) -> str:
    return f"trim({value}, '{WHITE_SPACE}')"


def _key(text: str) -> str:
    lowered = f"regexp_replace(lower({_bare(text)}), '\\s+', ' ', 'g')"
    return f"coalesce({_bare(f"regexp_replace({lowered}, '\\s*\\([^)]*\\)', '', 'g')")}, '')"


def _text(value: str) -> str:
    return f"CASE WHEN {_bare(value)} <> '' THEN {value} END"


def _int(value: str) -> str:
    return f"CASE WHEN regexp_full_match({_bare(value)}, '[+-]?[0-9]+') THEN CAST({_bare(value)} AS BIGINT) END"


def _bool(value: str) -> str:
    return (
        f"CASE WHEN lower({_bare(value)}) IN ('yes', 'y', 'true', 't', '1') THEN true"
        f" WHEN lower({_bare(value)}) IN ('no', 'n', 'false', 'f', '0') THEN false END"
    )


def _canonical(dialect: str, native: str, scale: str) -> str:
    branches = []
    for name, families in NATIVE_TYPES.items():
        inner = [f"WHEN {_key(native)} LIKE '%[]' THEN 'SEMI_STRUCTURED'"] if name == "postgresql" else []
        for family, names in families.items():
            value = f"CASE WHEN {scale} = 0 THEN 'INTEGER' ELSE 'DECIMAL' END" if family == "FIXED_POINT" else f"'{family}'"
            inner.append(f"WHEN {_key(native)} IN ({', '.join(repr(item) for item in names)}) THEN {value}")
        branches.append(f"WHEN {dialect} = '{name}' THEN CASE {' '.join(inner)} ELSE 'UNKNOWN' END")
    return f"CASE {' '.join(branches)} ELSE 'UNKNOWN' END"


_NORMALIZED_SQL = f"""
    SELECT dialect AS system, table_id, {_text("table_catalog")} AS catalog_name, {_text("schema_name")} AS schema_name,
           {_text("column_name")} AS column_name,
           CAST({_int("ordinal_position")} AS INTEGER) AS ordinal_position, {_text("data_type")} AS native_type,
           canonical AS canonical_type,
           CASE lower({_bare("is_nullable")}) WHEN 'yes' THEN true WHEN 'no' THEN false END AS nullable,
           CAST({_int("character_maximum_length")} AS INTEGER) AS character_length,
           CAST(CASE WHEN dialect = 'postgresql' AND canonical = 'INTEGER' AND numeric_precision_radix = '2' AND digits > 0
                     THEN floor((digits - 1) * log10(2)) + 1 ELSE digits END AS INTEGER) AS numeric_precision,
           CAST(scale AS INTEGER) AS numeric_scale,
           CAST({_int("datetime_precision")} AS INTEGER) AS datetime_precision,
           {_text("column_default")} AS default_expression, {_text("column_comment")} AS comment,
           {_text("collation_name")} AS collation, {_text("identity_generation")} AS identity_generation,
           {_text("generated_expression")} AS generation_expression,
           CASE WHEN dialect <> 'mysql' THEN {_bool("is_identity")} END AS is_identity,
           CASE dialect WHEN 'mysql' THEN contains(coalesce(extra, ''), 'auto_increment')
                        WHEN 'postgresql' THEN coalesce({_bool("is_identity")}, false)
                                            OR coalesce(column_default LIKE 'nextval(%', false)
                        ELSE {_bool("is_identity")} END AS is_auto_increment,
           CASE dialect WHEN 'mysql' THEN contains(lower(coalesce(extra, '')), 'generated')
                        WHEN 'postgresql' THEN CASE WHEN lower({_bare("is_generated")}) IN ('always', 'stored') THEN true
                                                    WHEN lower({_bare("is_generated")}) IN ('never', '') THEN false END
                        ELSE CASE WHEN lower({_bare("is_generated")}) IN ('virtual', 'virtual_column') THEN true
                                  WHEN lower({_bare("is_generated")}) IN ('column', '') THEN false END END AS is_generated,
           {_bool("is_primary_key")} AS is_primary_key, {_bool("is_foreign_key")} AS is_foreign_key,
           {_bool("unique_key")} AS is_unique_key,
           CAST(NULL AS INTEGER) AS array_dimensions,
           {_text("element_native_type")} AS element_native_type,
           CASE WHEN upper({_bare("element_canonical_type")}) IN ('DECIMAL', 'DATE') THEN upper({_bare("element_canonical_type")})
                WHEN {_bare("element_native_type")} <> ''
                THEN {_canonical("dialect", "element_native_type", "CAST(NULL AS INTEGER)")} END AS element_canonical_type
    FROM (SELECT *, {_canonical("dialect", "data_type", "scale")} AS canonical,
                 {_int("numeric_precision")} AS digits
          FROM (SELECT *, {_int("numeric_scale")} AS scale FROM ({on_duckdb(RAW_COLUMNS_SQL)}) AS r0) AS r1) AS r2
"""

_READABLE = "coalesce(column_name <> '', false) AND coalesce(ordinal_position > 0, false) AND coalesce(native_type <> '', false)"
_FOREIGN_SQL = on_duckdb(FOREIGN_ROWS_SQL)


def _json_text(columns: list[str]) -> str:
    parts = [f"'\"{name}\":', coalesce('\"' || {name} || '\"', 'null')" for name in sorted(columns)]
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


def _richest_sql(relation: str, identity: list[str], others: list[str]) -> str:
    rich = " + ".join(f"CASE WHEN {name} IS NOT NULL THEN 1 ELSE 0 END" for name in others)
    return f"""
        SELECT {", ".join([*identity, *others])} FROM {relation}
        QUALIFY row_number() OVER (PARTITION BY {", ".join(identity)}
                                   ORDER BY {rich} DESC, {_json_text([*identity, *others])}) = 1
    """


def _identity(rows: str) -> str:
    """Rows with the key that tells constraints apart: id, else name, else the row itself."""
    number = "row_number() OVER ()"
    return f"""
        SELECT *, coalesce({_text("constraint_id")}, {_text("constraint_name")}, concat('#', CAST({number} AS VARCHAR))) AS key
        FROM ({rows}) AS r
    """


def _first_places(relation: str, listed: str, order: str, keys: str) -> str:
    """Members of each key at their first place."""
    return f"""
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY key_sequence NULLS LAST, {order}, pos) AS nth FROM (
            SELECT * FROM (SELECT *, unnest({listed}) AS member, unnest(range(len({listed}))) AS pos FROM {relation}) AS u
            QUALIFY row_number() OVER (PARTITION BY {keys}, member ORDER BY key_sequence NULLS LAST, {order}, pos) = 1) AS m
    """


_KEYS_SQL = f"""
    SELECT *, CASE WHEN len(column_names) > 0 THEN column_names WHEN column_name <> '' THEN [column_name] ELSE [] END AS listed
    FROM ({_identity(on_duckdb(KEY_ROWS_SQL.replace("{array}", "list_value")))}) AS i
"""
_KEY_ID = "table_id, constraint_type, key"
_KEY_FIELDS = (
    "column_name", "column_names", "comment", "constraint_id", "constraint_name", "constraint_type", "is_validated",
    "key_sequence", "table_id",
)
_KEY_JSON = "CAST(to_json({" + ", ".join(f"'{name}': {name}" for name in _KEY_FIELDS) + "}) AS VARCHAR)"
_KEY_RICHNESS = " + ".join(
    f"coalesce(len({name}), 0)" if name == "column_names" else f"CAST({name} IS NOT NULL AS INT)" for name in _KEY_FIELDS
)
_KEY_LISTS_SQL = f"""
    SELECT {_KEY_ID}, list(member ORDER BY nth) AS members
    FROM ({_first_places("k", "listed", "listed", _KEY_ID)}) AS p GROUP BY {_KEY_ID}
"""
_KEY_LIST_SQL = f"""
    SELECT d.table_id, d.constraint_type, constraint_id, constraint_name, comment, is_validated,
           coalesce(array_to_string(members, '|'), '') AS columns
    FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {_KEY_ID} ORDER BY {_KEY_RICHNESS} DESC, {_KEY_JSON}) = 1) AS d
    LEFT JOIN ({_KEY_LISTS_SQL}) AS m USING ({_KEY_ID})
"""

_PAIRS_SQL = f"""
    SELECT * FROM ({_identity(_FOREIGN_SQL)}) AS f
    WHERE local_column_name <> '' AND referenced_column_name <> '' AND referenced_table <> '' AND key_sequence > 0
    QUALIFY row_number() OVER (
        PARTITION BY table_id, key, key_sequence
        ORDER BY constraint_name, expected_column_count, local_column_name, referenced_column_name, referenced_table) = 1
"""

_FRAGMENTS_DUCK = f"""
    SELECT *, CASE WHEN len(local_columns) > 0 THEN local_columns WHEN local_column_name <> '' THEN [local_column_name]
                   ELSE [] END AS l,
           CASE WHEN len(foreign_column_names) > 0 THEN foreign_column_names
                WHEN referenced_column_name <> '' THEN [referenced_column_name] ELSE [] END AS r
    FROM ({_identity(on_duckdb(FRAGMENTS_SQL.replace("{array}", "list_value")))}) AS i
"""


def _side(listed: str, name: str) -> str:
    places = _first_places("f", listed, "l, r", "table_id, key")
    return f"(SELECT table_id, key, list(member ORDER BY nth) AS {name} FROM ({places}) AS p GROUP BY table_id, key)"


_FRAGMENT_LISTS = f"""
    f AS MATERIALIZED ({_FRAGMENTS_DUCK}),
    lists AS (
        SELECT k.*, coalesce(a.left_list, []) AS left_list, coalesce(b.right_list, []) AS right_list
        FROM (SELECT DISTINCT table_id, key, constraint_id, constraint_name FROM f) AS k
        LEFT JOIN {_side("l", "left_list")} AS a USING (table_id, key)
        LEFT JOIN {_side("r", "right_list")} AS b USING (table_id, key)
    )
"""


def _dedup_list(column: str) -> str:
    """Two members at most: the second is dropped when it repeats the first."""
    items = f"list({column} ORDER BY key_sequence)"
    return f"CASE WHEN {items}[1] = {items}[2] THEN {items}[1:1] ELSE {items} END"


_FOREIGN_LIST_SQL = f"""
    SELECT table_id, constraint_id, max(constraint_name) AS constraint_name, max(referenced_table) AS referenced_table,
           {_dedup_list("local_column_name")} AS local_list, {_dedup_list("referenced_column_name")} AS referenced_list
    FROM pairs GROUP BY table_id, constraint_id, key
"""

_COVERAGE_SQL = f"""
    WITH k AS MATERIALIZED ({_KEYS_SQL}), f AS MATERIALIZED ({_identity(_FOREIGN_SQL)}),
    pk AS (
        SELECT table_id, bool_and(coalesce(len(listed) > 0 AND key_sequence > 0 AND trim(constraint_id) <> '', false)) AS ok
        FROM k WHERE constraint_type = 'p' GROUP BY table_id
    ),
    uq AS (
        SELECT table_id, bool_and(coalesce(len(members) = 1, false) OR coalesce(placed AND len(members) > 0, false) OR coalesce(explicit, false)) AS ok
        FROM (
            SELECT {_KEY_ID}, any_value(members) AS members, bool_and(len(listed) > 0 AND key_sequence IS NOT NULL) AS placed,
                   bool_or(column_names = members) AS explicit
            FROM k LEFT JOIN ({_KEY_LISTS_SQL}) AS m USING ({_KEY_ID})
            WHERE constraint_type = 'u' GROUP BY {_KEY_ID}) AS per_key
        GROUP BY table_id
    ),
    fk AS (
        SELECT table_id, bool_and(ok) AS ok FROM (
            SELECT table_id, count(*) = max(expected_column_count) AND count(DISTINCT key_sequence) = count(*)
                AND count(DISTINCT local_column_name) = count(*) AND count(DISTINCT referenced_column_name) = count(*)
                AND max(key_sequence) <= max(expected_column_count) AND bool_and(local_column_name IS NOT NULL)
                AND bool_and(trim(constraint_id) <> '') AS ok
            FROM f GROUP BY table_id, key) AS per_key
        GROUP BY table_id
    )
    SELECT t.table_id,
           CASE WHEN coalesce(pk.ok, true) THEN 'COMPLETE' ELSE 'PARTIAL' END AS primary_key,
           CASE WHEN coalesce(uq.ok, true) THEN 'COMPLETE' ELSE 'PARTIAL' END AS unique_constraints,
           CASE WHEN coalesce(fk.ok, true) THEN 'COMPLETE' ELSE 'PARTIAL' END AS foreign_keys,
           'UNAVAILABLE' AS check_constraints
    FROM (SELECT concat('t', o_orderkey) AS table_id FROM orders) AS t
    LEFT JOIN pk USING (table_id) LEFT JOIN uq USING (table_id) LEFT JOIN fk USING (table_id)
"""

def _object(fields: dict[str, str] | tuple[str, ...]) -> str:
    """A JSON object with sorted keys, as DuckDB struct."""
    named = fields if isinstance(fields, dict) else {name: f'"{name}"' for name in fields}
    return "{" + ", ".join(f"'{name}': {named[name]}" for name in sorted(named)) + "}"


def _json(fields: dict[str, str] | tuple[str, ...]) -> str:
    return f"CAST(to_json({_object(fields)}) AS VARCHAR)"


def _values(names: tuple[str, ...], lists: tuple[str, ...] = ()) -> str:
    return " + ".join(f"len({name})" if name in lists else f'CAST("{name}" IS NOT NULL AS INT)' for name in names)


_CHECK_FIELDS = ("table_id", "constraint_name", "expression", "is_enforced", "is_validated", "is_rely", "comment")
_CHECKS_DUCK = f"""
    SELECT * FROM (
        SELECT table_id, {_text("constraint_name")} AS constraint_name, coalesce({_text("check_clause")}, '') AS expression,
               CAST(NULL AS BOOLEAN) AS is_enforced, {_bool("convalidated")} AS is_validated, CAST(NULL AS BOOLEAN) AS is_rely,
               {_text("comment")} AS comment, coalesce(check_clause <> '', false) AS readable
        FROM ({on_duckdb(CHECKS_SQL)}) AS r) AS c
    WHERE readable
    QUALIFY row_number() OVER (PARTITION BY table_id, constraint_name, expression
                               ORDER BY {_values(_CHECK_FIELDS)} DESC, {_json(_CHECK_FIELDS)}) = 1
"""

_COLUMN_FIELDS = (
    "system", "catalog_name", "schema_name", "column_name", "ordinal_position", "native_type", "canonical_type", "nullable",
    "character_length", "numeric_precision", "numeric_scale", "datetime_precision", "default_expression", "comment", "collation",
    "identity_generation", "generation_expression", "is_identity", "is_auto_increment", "is_generated", "is_primary_key",
    "is_foreign_key", "is_unique_key", "array_dimensions", "element_native_type", "element_canonical_type",
)
_KEY_ITEM = ("constraint_id", "constraint_name", "comment", "is_validated", "columns")
_FOREIGN_ITEM = ("constraint_id", "constraint_name", "referenced_table", "local_columns", "referenced_columns")
_CHECK_ITEM = ("constraint_name", "expression", "is_enforced", "is_validated", "is_rely", "comment")


def _unread(facet: str) -> str:
    return f"EXISTS (SELECT 1 FROM outcomes x WHERE x.table_id = t.table_id AND x.facet = '{facet}')"


def _mark(name: str, members: str, coverage: str) -> str:
    return f"""CASE WHEN EXISTS (SELECT 1 FROM {members} AS m WHERE m.table_id = c.table_id AND m.member = c.column_name) THEN true
                    WHEN v.{coverage} = 'COMPLETE' THEN false END AS {name}"""


_DOCUMENTS_SQL = f"""
    WITH tables AS ({on_duckdb(TABLES_SQL)}), outcomes AS ({on_duckdb(OUTCOMES_SQL)}),
    k AS MATERIALIZED ({_KEYS_SQL}), pairs AS ({_PAIRS_SQL}),
    constraint_facets AS ({_COVERAGE_SQL}),
    read AS (
        SELECT t.table_id, NOT {_unread("columns")} AS columns, NOT {_unread("keys")} AS keys, NOT {_unread("foreign_keys")} AS foreign_keys,
               NOT {_unread("check_constraints")} AS checks, NOT {_unread("view_definition")} AS views, NOT {_unread("partitioning")} AS parts
        FROM tables t
    ),
    key_rows AS (
        SELECT d.table_id, d.constraint_type, constraint_id, constraint_name, comment, is_validated, coalesce(members, []) AS columns
        FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {_KEY_ID} ORDER BY {_KEY_RICHNESS} DESC, {_KEY_JSON}) = 1) AS d
        LEFT JOIN ({_KEY_LISTS_SQL}) AS m USING ({_KEY_ID})
        JOIN read r ON r.table_id = d.table_id AND r.keys
    ),
    key_list AS (
        SELECT * FROM key_rows QUALIFY row_number() OVER (
            PARTITION BY table_id, constraint_type, constraint_name, columns
            ORDER BY {_values(("constraint_id", "constraint_name", "comment", "is_validated"))} + len(columns) DESC,
                     {_json((*_KEY_ITEM, "table_id", "constraint_type"))}) = 1
    ),
    fk_rows AS (
        SELECT l.table_id, constraint_id, constraint_name, referenced_table, local_list AS local_columns, referenced_list AS referenced_columns
        FROM ({_FOREIGN_LIST_SQL}) AS l JOIN read r ON r.table_id = l.table_id AND r.foreign_keys
    ),
    fk_list AS (
        SELECT * FROM fk_rows QUALIFY row_number() OVER (
            PARTITION BY table_id, constraint_name, local_columns, referenced_table, referenced_columns
            ORDER BY {_values(("constraint_id",))} DESC, {_json((*_FOREIGN_ITEM, "table_id"))}) = 1
    ),
    pk_members AS (SELECT DISTINCT table_id, unnest(columns) AS member FROM key_list WHERE constraint_type = 'p'),
    uk_members AS (SELECT DISTINCT table_id, unnest(columns) AS member FROM key_list WHERE constraint_type = 'u'),
    fk_members AS (SELECT DISTINCT table_id, unnest(local_columns) AS member FROM fk_list),
    cover AS (
        SELECT t.table_id,
               CASE WHEN NOT r.columns THEN 'UNAVAILABLE' WHEN n.partly THEN 'PARTIAL' ELSE 'COMPLETE' END AS columns,
               CASE WHEN NOT r.keys THEN 'UNAVAILABLE' ELSE f.primary_key END AS primary_key,
               CASE WHEN NOT r.keys THEN 'UNAVAILABLE' ELSE f.unique_constraints END AS unique_constraints,
               CASE WHEN NOT r.foreign_keys THEN 'UNAVAILABLE' ELSE f.foreign_keys END AS foreign_keys,
               CASE WHEN NOT r.checks THEN 'UNAVAILABLE' WHEN h.partly THEN 'PARTIAL' ELSE 'COMPLETE' END AS check_constraints,
               'COMPLETE' AS comments,
               CASE WHEN t.object_type IN ('VIEW', 'MATERIALIZED_VIEW') THEN 'NOT_APPLICABLE' ELSE 'COMPLETE' END AS estimated_row_count,
               CASE WHEN t.object_type NOT IN ('VIEW', 'MATERIALIZED_VIEW') THEN 'NOT_APPLICABLE'
                    WHEN r.views AND w.view_definition IS NOT NULL THEN 'COMPLETE' ELSE 'UNAVAILABLE' END AS view_definition,
               CASE WHEN t.object_type NOT IN ('TABLE', 'PARTITIONED_TABLE', 'FOREIGN_TABLE') THEN 'NOT_APPLICABLE'
                    WHEN NOT r.parts THEN 'UNAVAILABLE' ELSE coalesce(p.coverage, 'PARTIAL') END AS partitioning,
               'NOT_APPLICABLE' AS clustering, w.view_definition AS definition, p.is_partitioned, p.partitioning_expression
        FROM tables t JOIN read r USING (table_id) JOIN constraint_facets f USING (table_id)
        LEFT JOIN (SELECT table_id, bool_or(NOT ({_READABLE})) AS partly FROM ({_NORMALIZED_SQL}) AS n GROUP BY table_id) AS n USING (table_id)
        LEFT JOIN (SELECT table_id, bool_or(NOT coalesce(check_clause <> '', false)) AS partly FROM ({on_duckdb(CHECKS_SQL)}) AS c GROUP BY table_id) AS h
            USING (table_id)
        LEFT JOIN ({on_duckdb(VIEWS_SQL)}) AS w USING (table_id) LEFT JOIN ({on_duckdb(PARTITIONS_SQL)}) AS p USING (table_id)
    ),
    cols AS (
        SELECT * FROM ({_NORMALIZED_SQL}) AS n WHERE {_READABLE}
        QUALIFY row_number() OVER (PARTITION BY table_id, column_name, ordinal_position
                                   ORDER BY {_values(_COLUMN_FIELDS)} DESC, {_json((*_COLUMN_FIELDS, "table_id"))}) = 1
    ),
    marked AS (
        SELECT c.* EXCLUDE (is_primary_key, is_unique_key, is_foreign_key), {_mark("is_primary_key", "pk_members", "primary_key")},
               {_mark("is_unique_key", "uk_members", "unique_constraints")}, {_mark("is_foreign_key", "fk_members", "foreign_keys")}
        FROM cols c JOIN cover v USING (table_id)
    ),
    l_columns AS (SELECT table_id, list({_object(_COLUMN_FIELDS)} ORDER BY ordinal_position, column_name) AS items FROM marked GROUP BY table_id),
    l_pk AS (SELECT table_id, list({_object(_KEY_ITEM)} ORDER BY constraint_name, columns) AS items FROM key_list WHERE constraint_type = 'p' GROUP BY table_id),
    l_uk AS (SELECT table_id, list({_object(_KEY_ITEM)} ORDER BY constraint_name, columns) AS items FROM key_list WHERE constraint_type = 'u' GROUP BY table_id),
    l_fk AS (SELECT table_id, list({_object(_FOREIGN_ITEM)} ORDER BY constraint_name, local_columns, referenced_columns) AS items FROM fk_list GROUP BY table_id),
    l_ck AS (SELECT table_id, list({_object(_CHECK_ITEM)} ORDER BY constraint_name NULLS LAST, expression) AS items FROM ({_CHECKS_DUCK}) AS c GROUP BY table_id)
    SELECT t.table_id, {_json({
        "catalog_name": "t.catalog_name", "schema_name": "t.schema_name", "object_name": "t.object_name", "object_type": "t.object_type",
        "owner": "t.owner", "comment": "t.comment", "estimated_row_count": "t.estimated_row_count",
        "columns": "CASE WHEN r.columns THEN coalesce(a.items, []) ELSE [] END", "primary_key": "b.items[1]",
        "unique_constraints": "coalesce(u.items, [])", "foreign_keys": "coalesce(f.items, [])",
        "check_constraints": "CASE WHEN r.checks THEN coalesce(h.items, []) ELSE [] END",
        "view_definition": "CASE WHEN v.view_definition = 'COMPLETE' THEN v.definition END",
        "is_partitioned": "CASE WHEN v.partitioning IN ('COMPLETE', 'PARTIAL') THEN v.is_partitioned END",
        "partitioning_expression": "CASE WHEN v.partitioning IN ('COMPLETE', 'PARTIAL') THEN v.partitioning_expression END",
        "coverage": _object({name: f"v.{name}" for name in (
            "columns", "primary_key", "unique_constraints", "foreign_keys", "check_constraints", "comments", "estimated_row_count",
            "view_definition", "partitioning", "clustering")}),
        "warnings": """list_filter([CASE WHEN v.check_constraints = 'PARTIAL' THEN 'CHECK_CONSTRAINTS_PARTIAL' END,
            CASE WHEN NOT r.checks THEN 'CHECK_CONSTRAINTS_UNAVAILABLE' END, CASE WHEN v.columns = 'PARTIAL' THEN 'COLUMNS_PARTIAL' END,
            CASE WHEN NOT r.columns THEN 'COLUMNS_UNAVAILABLE' END, CASE WHEN v.foreign_keys = 'PARTIAL' THEN 'FOREIGN_KEYS_PARTIAL' END,
            CASE WHEN NOT r.foreign_keys THEN 'FOREIGN_KEYS_UNAVAILABLE' END, CASE WHEN NOT r.keys THEN 'KEY_CONSTRAINTS_UNAVAILABLE' END,
            CASE WHEN v.partitioning = 'PARTIAL' THEN 'PARTITIONING_PARTIAL' END, CASE WHEN v.partitioning = 'UNAVAILABLE' THEN 'PARTITIONING_UNAVAILABLE' END,
            CASE WHEN v.primary_key = 'PARTIAL' THEN 'PRIMARY_KEY_PARTIAL' END,
            CASE WHEN v.unique_constraints = 'PARTIAL' THEN 'UNIQUE_CONSTRAINTS_PARTIAL' END,
            CASE WHEN v.view_definition = 'UNAVAILABLE' THEN 'VIEW_DEFINITION_UNAVAILABLE' END], lambda x: x IS NOT NULL)""",
    })} AS document
    FROM tables t JOIN read r USING (table_id) JOIN cover v USING (table_id)
    LEFT JOIN l_columns a USING (table_id) LEFT JOIN l_pk b USING (table_id) LEFT JOIN l_uk u USING (table_id)
    LEFT JOIN l_fk f USING (table_id) LEFT JOIN l_ck h USING (table_id)
"""

_OBJECT_IDENTITY = ["catalog_name", "schema_name", "object_name", "object_type"]


def _typed_objects(kind: str, persistence: str, rows: str, relation: str) -> str:
    typed = f"""
        SELECT catalog_name, schema_name, object_name, {kind} AS object_type, {persistence} AS persistence, owner,
               {rows} AS rows
        FROM ({relation}) AS o
    """
    final = f"""
        SELECT catalog_name, schema_name, object_name, object_type, persistence, {_text("owner")} AS owner,
               CASE WHEN object_type NOT IN ('VIEW', 'UNKNOWN') AND rows >= 0 AND rows = floor(rows)
                    THEN CAST(rows AS BIGINT) END AS estimated_row_count
        FROM ({typed}) AS t
    """
    names = ["persistence", "owner"]
    parts = {name: f"coalesce('\"' || {name} || '\"', 'null')" for name in names}
    text = (
        "concat('\"estimated_row_count\":', coalesce(CAST(estimated_row_count AS VARCHAR), 'null'), ',', "
        f"{parts['owner']}, ',', {parts['persistence']})"
    )
    rich = "CASE WHEN owner IS NULL THEN 0 ELSE 1 END + CASE WHEN estimated_row_count IS NULL THEN 0 ELSE 1 END"
    return f"""
        SELECT * FROM ({final}) AS f
        QUALIFY row_number() OVER (PARTITION BY {", ".join(_OBJECT_IDENTITY)} ORDER BY {rich} DESC, {text}) = 1
    """


_PG_KIND = """CASE lower(trim(relkind)) WHEN 'r' THEN 'TABLE' WHEN 'p' THEN 'PARTITIONED_TABLE' WHEN 'v' THEN 'VIEW'
    WHEN 'm' THEN 'MATERIALIZED_VIEW' WHEN 'f' THEN 'FOREIGN_TABLE' ELSE 'UNKNOWN' END"""
_SF_KIND = f"""CASE WHEN {_bool("is_dynamic")} THEN 'DYNAMIC_TABLE' ELSE CASE lower(table_type)
    WHEN 'base table' THEN 'TABLE' WHEN 'view' THEN 'VIEW' WHEN 'materialized view' THEN 'MATERIALIZED_VIEW'
    WHEN 'external table' THEN 'EXTERNAL_TABLE' ELSE 'UNKNOWN' END END"""
_SF_PERSISTENCE = f"""CASE WHEN coalesce({_bool("is_temporary")}, false) OR table_type = 'TEMPORARY TABLE' THEN 'TEMPORARY'
    WHEN {_bool("is_transient")} THEN 'TRANSIENT'
    WHEN NOT {_bool("is_temporary")} AND NOT {_bool("is_transient")} AND {_SF_KIND} <> 'UNKNOWN' THEN 'PERMANENT'
    ELSE 'UNKNOWN' END"""
_SF_OBJECTS = _typed_objects(
    _SF_KIND, _SF_PERSISTENCE, "row_count", f"SELECT *, CAST(NULL AS VARCHAR) AS owner FROM ({on_duckdb(SF_OBJECTS_SQL)})"
)


def _partition_sql(has_helpers: bool) -> str:
    expression = "s.partition_key" if has_helpers else "CAST(NULL AS VARCHAR)"
    complete = "true" if has_helpers else "NOT (c.relkind = 'p' OR i.parent_id IS NOT NULL)"
    return f"""
        SELECT c.relation_id, c.relkind = 'p' AS is_partitioned, i.parent_id IS NOT NULL AS is_partition_child,
               i.parent_id, CASE s.partstrat WHEN 'h' THEN 'HASH' WHEN 'l' THEN 'LIST' WHEN 'r' THEN 'RANGE' END
                   AS partition_strategy,
               {expression} AS partitioning_expression, i.partition_bound,
               CASE WHEN c.relkind = 'v' THEN 'NOT_APPLICABLE' WHEN {complete} THEN 'COMPLETE' ELSE 'PARTIAL' END
                   AS coverage
        FROM ({on_duckdb(CLASSES_SQL)}) c LEFT JOIN ({on_duckdb(INHERITS_SQL)}) i ON i.child_id = c.relation_id
        LEFT JOIN ({on_duckdb(STRATEGIES_SQL)}) s
            ON s.strategy_id = CASE WHEN c.relkind = 'p' THEN c.relation_id ELSE i.parent_id END
    """


ORACLES = {
    "normalize_columns": _NORMALIZED_SQL,
    "normalize_native_types": f"""
        SELECT system, native_type, canonical_type, count(*) AS columns FROM ({_NORMALIZED_SQL}) AS n GROUP BY ALL
    """,
    "column_quarantine": f"""
        SELECT table_id, CASE WHEN bool_and({_READABLE}) THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage,
               count(*) FILTER (WHERE {_READABLE}) AS kept_columns
        FROM ({_NORMALIZED_SQL}) AS n GROUP BY table_id
    """,
    "key_membership": f"WITH k AS MATERIALIZED ({_KEYS_SQL}) {_KEY_LIST_SQL}",
    "fk_pairs": f"SELECT * EXCLUDE (key) FROM ({_PAIRS_SQL}) AS p",
    "fk_membership": f"""
        WITH pairs AS ({_PAIRS_SQL}), lists AS ({_FOREIGN_LIST_SQL})
        SELECT table_id, constraint_id, constraint_name, referenced_table,
               array_to_string(local_list, '|') AS local_columns,
               array_to_string(referenced_list, '|') AS referenced_columns
        FROM lists
    """,
    "fk_unnested": f"""
        WITH {_FRAGMENT_LISTS}
        SELECT table_id, constraint_id, constraint_name, CAST(n AS INTEGER) AS key_sequence,
               left_list[n] AS local_column_name, right_list[n] AS referenced_column_name
        FROM (SELECT *, unnest(range(1, greatest(len(left_list), len(right_list)) + 1)) AS n FROM lists) AS u
    """,
    "fk_membership_coverage": f"""
        WITH {_FRAGMENT_LISTS},
        pairs AS (
            SELECT table_id, key, pair, bool_or(key_sequence IS NOT NULL) AS placed
            FROM (SELECT table_id, key, key_sequence, unnest(list_zip(l, r)) AS pair FROM f WHERE len(l) = len(r)) AS p
            GROUP BY ALL
        ),
        wanted AS (SELECT table_id, key, unnest(list_zip(left_list, right_list)) AS pair FROM lists),
        met AS (
            SELECT w.table_id, w.key, bool_and(p.pair IS NOT NULL) AS paired, bool_and(coalesce(p.placed, false)) AS covered
            FROM wanted w LEFT JOIN pairs p ON p.table_id = w.table_id AND p.key = w.key AND p.pair = w.pair GROUP BY ALL
        ),
        judged AS (
            SELECT x.table_id, x.key,
                   len(any_value(left_list)) > 0 AND len(any_value(left_list)) = len(any_value(right_list))
                   AND (bool_or(l = left_list AND r = right_list AND (len(local_columns) > 0 OR len(foreign_column_names) > 0))
                        OR (len(any_value(left_list)) = 1 AND any_value(paired))
                        OR (bool_and(len(l) > 0 AND len(l) = len(r) AND key_sequence IS NOT NULL) AND any_value(covered))) AS ok
            FROM lists x JOIN f ON f.table_id = x.table_id AND f.key = x.key
            LEFT JOIN met ON met.table_id = x.table_id AND met.key = x.key
            GROUP BY x.table_id, x.key
        )
        SELECT table_id, CASE WHEN bool_and(coalesce(ok, false)) THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage
        FROM judged GROUP BY table_id
    """,
    "fk_references": """
        SELECT concat('t', o.o_orderkey) AS table_id, concat('fk', o.o_orderkey) AS constraint_name,
               concat('pk', o.o_orderkey * 2) AS referenced_constraint,
               CASE WHEN p.o_orderkey IS NOT NULL THEN concat('t', p.o_orderkey) END AS referenced_table_id
        FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey * 2 WHERE o.o_orderkey % 3 = 0
    """,
    "constraint_coverage": _COVERAGE_SQL,
    "table_warnings": f"""
        SELECT table_id, concat_ws(',', 'CHECK_CONSTRAINTS_UNAVAILABLE',
                                   CASE foreign_keys WHEN 'PARTIAL' THEN 'FOREIGN_KEYS_PARTIAL' END,
                                   CASE primary_key WHEN 'PARTIAL' THEN 'PRIMARY_KEY_PARTIAL' END,
                                   CASE unique_constraints WHEN 'PARTIAL' THEN 'UNIQUE_CONSTRAINTS_PARTIAL' END)
                   AS warnings, true AS codes_valid
        FROM ({_COVERAGE_SQL}) AS c
    """,
    "default_facets": """
        SELECT concat('t', o_orderkey) AS table_id, 'COMPLETE' AS columns, 'COMPLETE' AS primary_key,
               'UNAVAILABLE' AS check_constraints, 'COMPLETE' AS comments, 'COMPLETE' AS estimated_row_count,
               'UNAVAILABLE' AS partitioning,
               CASE WHEN o_orderstatus = 'P' THEN 'COMPLETE' ELSE 'NOT_APPLICABLE' END AS view_definition,
               'NOT_APPLICABLE' AS clustering
        FROM orders
    """,
    "membership_marks": f"""
        SELECT c.table_id, n.column_name,
               CASE WHEN EXISTS (SELECT 1 FROM ({_KEYS_SQL}) AS m WHERE m.table_id = c.table_id
                                 AND m.constraint_type = 'p' AND list_contains(m.listed, n.column_name)) THEN true
                    WHEN c.primary_key = 'COMPLETE' THEN false END AS is_primary_key
        FROM ({_COVERAGE_SQL}) AS c, (VALUES ('c0'), ('c1'), ('c2'), ('c3'), ('c4')) AS n(column_name)
    """,
    "richness_dedup": f"""
        SELECT table_id, column_name, comment, default_expression, CAST(to_json(tags) AS VARCHAR) AS tags,
               CAST(to_json(facts) AS VARCHAR) AS facts
        FROM ({on_duckdb(re.sub(r"{struct}\((.*) AS kind, (.*) AS parts\)", r"struct_pack(kind := \1, parts := \2)", DUPLICATES_SQL.replace("{array}", "list_value")))}) AS d
        QUALIFY row_number() OVER (PARTITION BY table_id, column_name ORDER BY
            CAST(comment IS NOT NULL AS INT) + CAST(default_expression IS NOT NULL AS INT) + len(list_filter(tags, lambda x: x IS NOT NULL))
            + CAST(facts.kind IS NOT NULL AS INT) + len(list_filter(facts.parts, lambda x: x IS NOT NULL)) DESC,
            CAST(to_json({{'column_name': column_name, 'comment': comment, 'default_expression': default_expression,
                           'facts': facts, 'table_id': table_id, 'tags': tags}}) AS VARCHAR)) = 1
    """,
    "pk_acceptance": f"""
        WITH h AS ({on_duckdb(HEADERS_SQL)}), m AS ({on_duckdb(MEMBERS_SQL)}),
        headers AS (SELECT table_id, count(*) AS headers, min(comment) AS comment FROM h GROUP BY table_id),
        members AS (
            SELECT table_id, bool_or(member_table_id <> table_id OR constraint_name <> 'pk') AS unmatched,
                   bool_or(m.column_name = '') AS unreadable,
                   bool_or(coalesce(h.comment <> m.comment, false)) AS conflict,
                   count(DISTINCT key_sequence) = count(*) AND count(DISTINCT column_name) = count(*)
                       AND min(key_sequence) = 1 AND max(key_sequence) = count(*) AS ordered,
                   string_agg(column_name, '|' ORDER BY key_sequence) AS columns
            FROM m LEFT JOIN headers h USING (table_id) GROUP BY table_id
        ),
        judged AS (
            SELECT h.table_id, m.columns,
                   CASE WHEN h.headers > 1 THEN 'PRIMARY_KEY_MEMBERSHIP_PARTIAL'
                        WHEN m.table_id IS NULL THEN 'PRIMARY_KEY_MEMBERSHIP_UNAVAILABLE'
                        WHEN unmatched THEN 'PRIMARY_KEY_MEMBERSHIP_UNMATCHED'
                        WHEN unreadable THEN 'PRIMARY_KEY_MEMBERSHIP_PARTIAL'
                        WHEN conflict THEN 'PRIMARY_KEY_MEMBERSHIP_CONFLICT'
                        WHEN NOT ordered THEN 'PRIMARY_KEY_MEMBERSHIP_PARTIAL' END AS warning
            FROM headers h LEFT JOIN members m USING (table_id)
        )
        SELECT table_id, 'pk' AS constraint_name, CASE WHEN warning IS NULL THEN columns END AS columns, warning
        FROM judged
    """,
    "array_chain": f"""
        WITH RECURSIVE rows AS (SELECT DISTINCT * FROM ({on_duckdb(ELEMENTS_SQL)}) AS e WHERE collection_id <> ''),
        defs AS (SELECT * FROM rows QUALIFY count(*) OVER (PARTITION BY collection_id) = 1),
        walk AS (
            SELECT collection_id, data_type, element_id, 1 AS dims, [collection_id] AS seen, false AS looped FROM defs
            UNION ALL
            SELECT w.collection_id, d.data_type, d.element_id, w.dims + 1, list_append(w.seen, w.element_id),
                   list_contains(w.seen, w.element_id)
            FROM walk w JOIN defs d ON d.collection_id = w.element_id
            WHERE NOT w.looped AND lower(trim(w.data_type)) = 'array' AND w.element_id IS NOT NULL
        ),
        last_step AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY dims DESC) = 1)
        SELECT collection_id,
               CASE WHEN NOT looped AND (lower(trim(data_type)) <> 'array' OR element_id IS NULL) THEN dims END
                   AS array_dimensions,
               CASE WHEN NOT looped AND (lower(trim(data_type)) <> 'array' OR element_id IS NULL) THEN data_type END
                   AS element_native_type,
               looped AS is_malformed
        FROM last_step
    """,
    "schema_classes": f"""
        SELECT catalog_name, schema_name, n_name AS owner, classification AS schema_classification,
               classification <> 'USER' AS is_system_managed
        FROM (SELECT *, CASE WHEN schema_name = 'pg_catalog' THEN 'POSTGRESQL_CATALOG'
                  WHEN schema_name = 'information_schema' THEN 'INFORMATION_SCHEMA'
                  WHEN left(schema_name, 14) = 'pg_toast_temp_' THEN 'POSTGRESQL_TOAST_TEMPORARY'
                  WHEN schema_name = 'pg_toast' OR left(schema_name, 9) = 'pg_toast_' THEN 'POSTGRESQL_TOAST'
                  WHEN left(schema_name, 8) = 'pg_temp_' THEN 'POSTGRESQL_TEMPORARY' ELSE 'USER' END AS classification
              FROM ({on_duckdb(NAMESPACES_SQL.replace("{text}", "VARCHAR"))}) AS n) AS c
        JOIN nation ON n_nationkey = owner_id AND n_nationkey <> 3
    """,
    "object_types": _typed_objects(
        _PG_KIND,
        """CASE lower(relpersistence) WHEN 'p' THEN 'PERMANENT' WHEN 'u' THEN 'UNLOGGED' WHEN 't' THEN 'TEMPORARY'
           ELSE 'UNKNOWN' END""",
        "reltuples",
        on_duckdb(PG_OBJECTS_SQL),
    ),
    "object_types_filtered": f"SELECT * FROM ({_SF_OBJECTS}) AS o WHERE object_type IN ('TABLE', 'DYNAMIC_TABLE', 'VIEW')",
    "partition_facts": _partition_sql(True),
    "partition_facts_without_helpers": _partition_sql(False),
    "live_columns": f"""
        SELECT a.relation_id, a.attnum, a.collation_id, d.default_expression, r.r_name AS collation
        FROM ({on_duckdb(ATTRIBUTES_SQL)}) a
        LEFT JOIN ({on_duckdb(DEFAULTS_SQL)}) d ON d.relation_id = a.relation_id AND d.attnum = a.attnum
        LEFT JOIN region r ON r.r_regionkey = a.collation_id AND r.r_regionkey < 2
        WHERE a.attnum > 0 AND NOT a.attisdropped
    """,
    "object_facets": """
        SELECT o_orderkey,
               CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 THEN 'COMPLETE'
                                                    ELSE 'UNAVAILABLE' END
                                   WHEN 1 THEN 'UNAVAILABLE' ELSE 'NOT_APPLICABLE' END AS snowflake_view,
               CASE WHEN o_orderkey % 4 > 1 THEN 'NOT_APPLICABLE' WHEN o_custkey % 3 <> 0 THEN 'COMPLETE'
                    ELSE 'UNAVAILABLE' END AS postgresql_view,
               CASE WHEN o_orderkey % 4 = 0 THEN 'NOT_APPLICABLE' WHEN o_custkey % 4 > 1 THEN 'UNAVAILABLE'
                    WHEN o_custkey % 4 = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS clustering,
               CASE lower(o_orderstatus) WHEN 'f' THEN 'FULL' WHEN 'p' THEN 'PARTIAL' END AS match_option,
               CASE WHEN o_custkey % 2 = 0 THEN 'NO ACTION' ELSE 'CASCADE' END AS delete_rule,
               CASE WHEN o_custkey % 2 = 0 THEN 'STORED' ELSE 'NONE' END AS generation_kind
        FROM orders
    """,
    "redacted_metadata": """
        SELECT event_id,
               concat('{"endpoints":[{"port":', user_id, '},{"port":', user_id, '}],"login":{},"note":"',
                      CASE WHEN event_type = 'error' THEN '[REDACTED_EXCEPTION]' ELSE event_type END,
                      '","options":{" User  Name ":"4","k', user_id, '":"6",',
                      CASE WHEN event_type <> 'error' THEN concat('"raw__driver ', event_type, '":"5",') ELSE '' END,
                      '"token_count":"3"}}') AS metadata,
               concat('{"a":{"m":1e5,"n":12345678901234567890.10,"ok":"tokens"},"err":"[REDACTED_EXCEPTION]","list":[{"v":[{"keep":',
                      event_id, '}]},["a",{}]]}') AS document
        FROM events
    """,
    "check_constraints": f"SELECT * EXCLUDE (readable) FROM ({_CHECKS_DUCK}) AS c",
    "table_documents": _DOCUMENTS_SQL,
    "owned_schemas": """
        SELECT 'DB' AS catalog_name, CASE WHEN c_custkey % 50 = 0 THEN 'INFORMATION_SCHEMA' ELSE c_name END AS schema_name,
               CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS owner,
               CASE WHEN c_custkey % 50 = 0 THEN 'INFORMATION_SCHEMA' ELSE 'USER' END AS schema_classification,
               c_custkey % 50 = 0 AS is_system_managed
        FROM customer
    """,
    "user_databases": """
        SELECT c_name AS name FROM customer WHERE c_custkey % 50 > 1
    """,
    "base_tables": """
        SELECT concat('t', o_orderkey) AS table_name FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 2 = 0
    """,
}
