"""Test tables, plans and shared SQL fragments of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablelift.operators.projection import null_out
from tablelift.plans.expressions import cast, coalesce, concat, copy_of, literal
from tablelift.plans.plan import Approval, Plan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with one market segment turned into NULL."""
    return null_out(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING")


CUSTOMER_SOURCE_SQL = """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment
    FROM customer
"""

CUSTOMER_PLAN = Plan(
    "customer",
    "customer_target",
    (
        Approval(
            "c_custkey", "APPROVED", "customer_key", T.DecimalType(38, 0), 1,
            compatibility="SAFE", transformation=cast("c_custkey", "DECIMAL"),
        ),
        Approval(
            "c_name", "APPROVED", "label", T.StringType(), 2,
            compatibility="EXACT", transformation=concat("c_name", "c_mktsegment", separator=" "),
        ),
        Approval(
            "c_nationkey", "APPROVED", "c_nationkey", T.IntegerType(), 3,
            compatibility="EXACT", transformation=copy_of("c_nationkey"),
        ),
        Approval(
            "c_acctbal", "OVERRIDDEN", "balance", T.DecimalType(18, 2), 4,
            compatibility="INCOMPATIBLE", transformation=cast("c_acctbal", "DECIMAL"),
            override_reason="Balances are kept to the cent.",
        ),
        Approval(
            "c_mktsegment", "APPROVED", "segment", T.StringType(), 5,
            compatibility="EXACT", transformation=coalesce("c_mktsegment", literal("UNKNOWN")),
        ),
    ),
)

CUSTOMER_TARGET_SQL = f"""
    SELECT CAST(c_custkey AS DECIMAL(38, 0)) AS customer_key,
           concat_ws(' ', c_name, c_mktsegment) AS label,
           c_nationkey,
           CAST(c_acctbal AS DECIMAL(18, 2)) AS balance,
           coalesce(c_mktsegment, 'UNKNOWN') AS segment
    FROM ({CUSTOMER_SOURCE_SQL}) AS src
"""


def copy_plan(frame: DataFrame, source: str, target: str) -> Plan:
    """Every column approved as a plain copy."""
    return Plan(
        source,
        target,
        tuple(
            Approval(
                field.name, "APPROVED", field.name, field.dataType, position,
                compatibility="EXACT", transformation=copy_of(field.name),
            )
            for position, field in enumerate(frame.schema.fields, start=1)
        ),
    )


def metric_sql(relation: str, columns: list[str]) -> str:
    """Long-form metrics of ``columns`` over a relation, one UNION ALL branch per check."""
    branches = [f"SELECT 'row_count' AS check_id, count(*) AS value FROM {relation}"]
    for index, name in enumerate(columns):
        branches.append(
            f"SELECT 'm{index:03d}_null_count', CAST(sum(CASE WHEN {name} IS NULL THEN 1 ELSE 0 END) AS BIGINT)"
            f" FROM {relation}"
        )
        branches.append(f"SELECT 'm{index:03d}_distinct_count', count(DISTINCT {name}) FROM {relation}")
    return "\n    UNION ALL ".join(branches)


def checks_sql(source_columns: list[str], target_columns: list[str]) -> str:
    rows = ["('row_count', 'ROW_COUNT', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR))"]
    for index, (source, target) in enumerate(zip(source_columns, target_columns)):
        rows.append(f"('m{index:03d}_null_count', 'NULL_COUNT', '{source}', '{target}')")
        rows.append(f"('m{index:03d}_distinct_count', 'DISTINCT_COUNT', '{source}', '{target}')")
    return "VALUES " + ", ".join(rows)


def reconcile_sql(
    source: str, target: str, source_values: list[str], source_columns: list[str], target_columns: list[str]
) -> str:
    """Paired metrics and their comparison; ``source`` and ``target`` are subqueries."""
    return f"""
WITH src AS ({source}), tgt AS ({target}),
sm AS ({metric_sql("src", source_values)}),
tm AS ({metric_sql("tgt", target_columns)}),
checks(check_id, check_type, source_column, target_column) AS ({checks_sql(source_columns, target_columns)})
SELECT c.check_id, c.check_type, c.source_column, c.target_column,
       sm.value AS source_value, tm.value AS target_value,
       CASE WHEN sm.value IS NULL OR tm.value IS NULL THEN 'UNAVAILABLE'
            WHEN sm.value = tm.value THEN 'MATCH' ELSE 'MISMATCH' END AS status,
       tm.value - sm.value AS difference
FROM checks c LEFT JOIN sm ON sm.check_id = c.check_id LEFT JOIN tm ON tm.check_id = c.check_id
"""


def report_sql(checked: str, plan_version: int = 1) -> str:
    return f"""
SELECT matched_count, mismatched_count, unavailable_count,
       CASE WHEN mismatched_count > 0 THEN 'FAILED' WHEN unavailable_count > 0 THEN 'INCOMPLETE'
            ELSE 'PASSED' END AS status,
       {plan_version} AS plan_version
FROM (SELECT CAST(count(*) FILTER (WHERE status = 'MATCH') AS BIGINT) AS matched_count,
             CAST(count(*) FILTER (WHERE status = 'MISMATCH') AS BIGINT) AS mismatched_count,
             CAST(count(*) FILTER (WHERE status = 'UNAVAILABLE') AS BIGINT) AS unavailable_count
      FROM ({checked}) AS checked) AS counts
"""
