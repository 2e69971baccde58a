"""Column catalogs derived from the test tables, as SQL both engines run.

Every order becomes a table and its parts become the columns, so a catalog grows
with lineitem. The target catalog renames, retypes, reorders, drops and doubles
columns by part key, which covers every evidence class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelift.queries.data import table
from tablelift.session import materialize, small_partitions

_ORDER_COLUMNS = """
    SELECT l_orderkey, p_name, min(l_linenumber) AS line, min(p_size) AS size,
           CAST(min(l_partkey) AS BIGINT) AS part, CAST(min(l_quantity) AS INT) AS quantity
    FROM {lineitem} AS l JOIN {part} AS p ON l.l_partkey = p.p_partkey
    GROUP BY l_orderkey, p_name
"""

_FAMILY = """CASE size % 9 WHEN 0 THEN 'STRING' WHEN 1 THEN 'STRING' WHEN 2 THEN 'INTEGER' WHEN 3 THEN 'DECIMAL'
    WHEN 4 THEN 'DATE' WHEN 5 THEN 'BOOLEAN' WHEN 6 THEN 'INTEGER' WHEN 7 THEN 'TIMESTAMP' ELSE 'UNKNOWN' END"""

SOURCE_COLUMNS_SQL = f"""
    SELECT concat('src_', l_orderkey) AS table_id,
           replace(p_name, ' ', '_') AS column_name,
           CASE WHEN part % 13 = 0 THEN NULL ELSE line END AS ordinal_position,
           family AS canonical_type,
           CASE size % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS nullable,
           CASE WHEN family = 'STRING' AND part % 4 <> 0 THEN 10 + quantity END AS character_length,
           CASE WHEN family IN ('INTEGER', 'DECIMAL') AND part % 4 <> 0 THEN 10 + quantity % 9 END AS numeric_precision,
           CASE WHEN family = 'DECIMAL' AND part % 4 <> 0 THEN quantity % 5 END AS numeric_scale,
           CASE WHEN family = 'TIMESTAMP' AND part % 4 <> 0 THEN quantity % 7 END AS datetime_precision
    FROM (SELECT *, {_FAMILY} AS family FROM ({_ORDER_COLUMNS}) AS c) AS f
"""

_CAMEL = """concat(split_part(p_name, ' ', 1), upper(substring(split_part(p_name, ' ', 2), 1, 1)),
    substring(split_part(p_name, ' ', 2), 2))"""

_TARGET_NAME = f"""CASE part % 9 WHEN 1 THEN upper(replace(p_name, ' ', '_')) WHEN 2 THEN {_CAMEL}
    WHEN 3 THEN replace(p_name, ' ', '-') WHEN 4 THEN upper(p_name)
    WHEN 5 THEN concat(split_part(p_name, ' ', 2), '_', split_part(p_name, ' ', 1))
    ELSE replace(p_name, ' ', '_') END"""

_TARGET_FAMILY = f"""CASE WHEN part % 5 = 0 AND size % 9 IN (2, 6) THEN 'DECIMAL'
    WHEN part % 5 = 0 AND size % 9 = 4 THEN 'TIMESTAMP' WHEN part % 11 = 0 THEN 'BOOLEAN' ELSE {_FAMILY} END"""

TARGET_COLUMNS_SQL = f"""
    SELECT concat('tgt_', l_orderkey) AS table_id, column_name,
           CASE WHEN part % 17 = 0 THEN NULL WHEN part % 6 = 0 THEN line + 3 ELSE line END AS ordinal_position,
           family AS canonical_type,
           CASE (size + part) % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS nullable,
           CASE WHEN family = 'STRING' AND part % 10 <> 0 THEN 10 + quantity - part % 3 END AS character_length,
           CASE WHEN family IN ('INTEGER', 'DECIMAL') AND part % 10 <> 0 THEN 11 + quantity % 9 - part % 3 END
               AS numeric_precision,
           CASE WHEN family = 'DECIMAL' AND part % 10 <> 0 THEN quantity % 5 END AS numeric_scale,
           CASE WHEN family = 'TIMESTAMP' AND part % 10 <> 0 THEN quantity % 7 END AS datetime_precision
    FROM (
        SELECT l_orderkey, line, size, part, quantity, {_TARGET_NAME} AS column_name, {_TARGET_FAMILY} AS family
        FROM ({_ORDER_COLUMNS}) AS c WHERE part % 9 <> 6
        UNION ALL
        SELECT l_orderkey, line + 1, size, part, quantity, {_CAMEL}, {_FAMILY}
        FROM ({_ORDER_COLUMNS}) AS d WHERE part % 9 = 7
    ) AS f
"""

PAIRS_SQL = """
    SELECT concat('src_', o_orderkey) AS source_table, concat('tgt_', o_orderkey) AS target_table FROM {orders}
"""


def on_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    small_partitions(spark)
    names = [name for name in ("lineitem", "part", "orders", "events", "customer") if "{" + name + "}" in sql]
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def column_catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Columns of the source and of the target catalog. What both are made from is joined, folded and written once."""
    built = materialize(on_spark(spark, sf_dir, _ORDER_COLUMNS), "order-columns")
    source, target = (sql.replace(_ORDER_COLUMNS, "SELECT * FROM {built}") for sql in (SOURCE_COLUMNS_SQL, TARGET_COLUMNS_SQL))
    return spark.sql(source, built=built), spark.sql(target, built=built)


def on_duckdb(sql: str) -> str:
    names = ("lineitem", "part", "orders", "events", "customer")
    return sql.format(**{name: name for name in names})
