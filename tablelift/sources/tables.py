"""Bounded scans of files, tables and queries, and the columns frame of a schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.functions.types import family_of
from tablelift.plans.expressions import column, quote
from tablelift.plans.limits import effective_limit

COLUMNS_SCHEMA = (
    "table_id string, column_name string, ordinal_position int, native_type string, canonical_type string,"
    " nullable boolean, character_length int, numeric_precision int, numeric_scale int, datetime_precision int"
)

# Decimal digits of Spark's integral types.
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def scan(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns, in the listed order; Catalyst prunes the rest at the source."""
    return frame.select(*[column(name) for name in columns])


def query(
    spark: SparkSession,
    sql: str,
    args: Mapping[str, Any] | None = None,
    *,
    max_rows: int | None = None,
    profile_rows: int | None = None,
    **frames: DataFrame,
) -> DataFrame:
    """A SELECT with named parameters, capped at the lower of the requested and the profile's rows.

    Without either, all rows. ``frames`` may be used in the text as ``{name}``.
    """
    return capped(spark.sql(sql, args=dict(args or {}), **frames), max_rows, profile_rows)


def capped(frame: DataFrame, max_rows: int | None, profile_rows: int | None = None) -> DataFrame:
    """The frame cut at the lower of two limits; whole where the caller names none."""
    if max_rows is None and profile_rows is None:
        return frame
    return frame.limit(effective_limit(max_rows, profile_rows if profile_rows is not None else max_rows))


def is_cut(frame: DataFrame, max_rows: int) -> bool:
    """Whether a limit of ``max_rows`` leaves rows out; at most one row more than the limit is read."""
    return frame.limit(max_rows + 1).count() > max_rows


def describe(table_id: str, schema: T.StructType) -> list[tuple]:
    """Canonical column rows of one Spark schema, in column order."""
    rows = []
    for position, field in enumerate(schema.fields, start=1):
        data_type = field.dataType
        precision = _DIGITS.get(data_type.simpleString())
        scale = 0 if precision else None
        if isinstance(data_type, T.DecimalType):
            precision, scale = data_type.precision, data_type.scale
        rows.append(
            (
                table_id,
                field.name,
                position,
                data_type.simpleString(),
                family_of(data_type),
                field.nullable,
                getattr(data_type, "length", None) if isinstance(data_type, (T.CharType, T.VarcharType)) else None,
                precision,
                scale,
                6 if family_of(data_type) in ("TIMESTAMP", "TIMESTAMP_TZ") else None,
            )
        )
    return rows


def columns_of(spark: SparkSession, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """The ``columns`` frame of several schemas; as long as the schemas are wide."""
    rows = [row for table_id, schema in schemas.items() for row in describe(table_id, schema)]
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").orderBy("namespace")


def tables(spark: SparkSession, database: str = "default") -> DataFrame:
    """Base tables of one database, by name; temporary views are left out."""
    listed = spark.sql(f"SHOW TABLES IN {quote(database)}").filter("NOT isTemporary")
    views = spark.sql(f"SHOW VIEWS IN {quote(database)}").filter("NOT isTemporary").select(F.col("viewName").alias("tableName"))
    names = listed.select("tableName").join(views, "tableName", "left_anti")
    return names.select(F.col("tableName").alias("table_name")).orderBy("table_name")
