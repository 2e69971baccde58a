"""Paired aggregate metrics: row count, null counts and distinct counts.

The source side measures the transformed value, the target side the stored
column. Both sides emit long form (check_id, value), so nothing depends on the
position of a metric and several aggregations can be unioned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.operators.projection import mapped_value
from tablelift.plans.expressions import column
from tablelift.plans.plan import Plan

CHECK_SCHEMA = "check_id string, check_type string, source_column string, target_column string"


@dataclass(frozen=True)
class Check:
    check_id: str
    check_type: str
    source_column: str | None = None
    target_column: str | None = None


def checks_of(plan: Plan) -> list[Check]:
    """1 + 2 per mapping; the distinct check is left out when compatibility is UNKNOWN."""
    checks = [Check("row_count", "ROW_COUNT")]
    for index, item in enumerate(plan.mappings):
        names = (item.source_column, item.target_column)
        checks.append(Check(f"m{index:03d}_null_count", "NULL_COUNT", *names))
        if item.compatibility != "UNKNOWN":
            checks.append(Check(f"m{index:03d}_distinct_count", "DISTINCT_COUNT", *names))
    return checks


def checks_frame(spark: SparkSession, checks: list[Check]) -> DataFrame:
    """The check list as a frame; as long as the plan is wide, never as the data is long."""
    rows = [(item.check_id, item.check_type, item.source_column, item.target_column) for item in checks]
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def long_form(frame: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregate once, then turn the one row into (check_id, value) rows."""
    wide = frame.agg(*[value.cast("bigint").alias(name) for name, value in aggregates.items()])
    return wide.unpivot([], list(aggregates), "check_id", "value")


def metrics(frame: DataFrame, values: list[tuple[Column, bool]], *, mode: str = "exact") -> DataFrame:
    """Metrics of ``values``, pairs of (column, count distinct values too)."""
    if mode not in ("exact", "approx"):
        raise ValueError("mode is 'exact' or 'approx'.")
    if mode == "exact":
        return exact_metrics(frame, values)
    aggregates: dict[str, Column] = {"row_count": F.count(F.lit(1))}
    for index, (value, with_distinct) in enumerate(values):
        # SUM, not count_if: over zero rows it is NULL, and the check becomes UNAVAILABLE.
        aggregates[f"m{index:03d}_null_count"] = F.sum(F.when(value.isNull(), 1).otherwise(0))
        if with_distinct:
            aggregates[f"m{index:03d}_distinct_count"] = F.approx_count_distinct(value)
    return long_form(frame, aggregates)


def value_key(value: Column, data_type: T.DataType) -> Column:
    """Text that two values share if and only if grouping takes them for equal; NULL for NULL."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0)).cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.hex(value)
    if isinstance(data_type, T.AtomicType):
        return value.cast("string")
    return F.when(value.isNotNull(), F.to_json(F.struct(value), {"ignoreNullFields": "false"}))


def exact_metrics(frame: DataFrame, values: list[tuple[Column, bool]]) -> DataFrame:
    """One plan for tables of any width: one scan, one shuffle of distinct values.

    A row becomes one short row per column, (column number, value key), whose groups are counted on the map side.
    A column has as many distinct values as groups with a key, its nulls are the group without one, and a column
    that is never null counts the rows. Columns without a distinct check share two keys.
    """
    named = frame.select(*[value.alias(f"v{index}") for index, (value, _) in enumerate(values)])
    keys = [
        value_key(F.col(f"v{index}"), named.schema[f"v{index}"].dataType) if distinct else F.when(F.col(f"v{index}").isNotNull(), "")
        for index, (_, distinct) in enumerate(values)
    ]
    cells = [F.struct(F.lit(index).alias("place"), key.alias("key")) for index, key in enumerate([*keys, F.lit("")])]
    groups = named.select(F.inline(F.array(*cells))).groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"))
    totals = groups.groupBy("place").agg(
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("key").alias("distinct"),
        F.sum("n").alias("rows"),
    )
    wanted = [("row_count", len(values), "rows")]
    for index, (_, distinct) in enumerate(values):
        wanted.append((f"m{index:03d}_null_count", index, "nulls"))
        if distinct:
            wanted.append((f"m{index:03d}_distinct_count", index, "distinct"))
    checks = frame.sparkSession.createDataFrame(wanted, "check_id string, place int, kind string")
    # Over zero rows there are no groups: no rows and no values, but null counts are unavailable.
    found = F.when(F.col("kind") == "nulls", F.col("nulls")).otherwise(
        F.coalesce(F.when(F.col("kind") == "rows", F.col("rows")).otherwise(F.col("distinct")), F.lit(0))
    )
    return checks.join(totals, "place", "left").select("check_id", found.cast("bigint").alias("value"))


def source_metrics(source: DataFrame, plan: Plan, *, null_mode: str = "propagate", mode: str = "exact") -> DataFrame:
    """Metrics of the transformed values, computed from the live source."""
    values = [
        (mapped_value(plan, item, null_mode=null_mode), item.compatibility != "UNKNOWN") for item in plan.mappings
    ]
    return metrics(source, values, mode=mode)


def target_metrics(target: DataFrame, plan: Plan, *, mode: str = "exact") -> DataFrame:
    """Metrics of the stored target columns."""
    values = [(column(item.target_column), item.compatibility != "UNKNOWN") for item in plan.mappings]
    return metrics(target, values, mode=mode)
