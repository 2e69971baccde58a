"""Publish: checked INSERT … SELECT from a staged frame into the target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablelift.operators.audits import is_lossy
from tablelift.operators.projection import mapped_value, project
from tablelift.plans.expressions import column, quote
from tablelift.plans.plan import Approval, Plan


class PublishRefused(ValueError):
    """The data breaks a rule of the target; nothing was written."""


def relation(name: str) -> str:
    return ".".join(quote(part) for part in name.split("."))


def _null_rule(plan: Plan, mapping: Approval, null_mode: str) -> Column:
    """The mapped value is NULL. A cast is judged by its input: it gives NULL only for NULL."""
    if mapping.transformation.kind == "CAST":
        return column(mapping.transformation.columns[0]).isNull()
    return mapped_value(plan, mapping, null_mode=null_mode).isNull()


def publish_rules(staged: DataFrame, plan: Plan, *, null_mode: str = "propagate") -> dict[str, Column]:
    """Conditions that no staged row may meet: NULL in a required column, or an approved cast that changes a value."""
    rules = {}
    for item in plan.mappings:
        if not item.target_nullable:
            rules[f"null:{item.target_column}"] = _null_rule(plan, item, null_mode)
        if item.transformation.kind == "CAST" and item.status == "APPROVED" and item.target_type is not None:
            name = item.transformation.columns[0]
            rules[f"lossy:{item.target_column}"] = is_lossy(column(name), staged.schema[name].dataType, item.target_type)
    return rules


def broken_rows(staged: DataFrame, plan: Plan, *, null_mode: str = "propagate") -> dict[str, int]:
    """Rows that break each rule. All rules share one pass; one aggregate row reaches the driver."""
    rules = publish_rules(staged, plan, null_mode=null_mode)
    return staged.agg(*[F.count_if(rule).alias(key) for key, rule in rules.items()]).first().asDict() if rules else {}


def publish(
    staged: DataFrame, plan: Plan, target: str, *, null_mode: str = "propagate", broken: dict[str, int] | None = None
) -> int:
    """Append the mapped rows and return how many were written.

    Columns the plan does not fill take their default or NULL. Plain casts that
    would change a value are refused unless the mapping was OVERRIDDEN. ``broken`` are the counts of ``publish_rules``
    where the load that wrote the staged rows has observed them; without it they take a pass of their own.
    """
    spark = staged.sparkSession
    if not plan.is_complete:
        raise PublishRefused("The plan still has pending columns.")
    counts = broken_rows(staged, plan, null_mode=null_mode) if broken is None else broken
    hit = {key: rows for key, rows in counts.items() if rows}
    if hit:
        raise PublishRefused(f"Rows that break the target: {hit}")
    projected = project(staged, plan, null_mode=null_mode)
    observed = Observation()
    counted = projected.observe(observed, F.count(F.lit(1)).alias("rows"))
    insert(spark, counted, target)
    return observed.get["rows"]


def insert(spark: SparkSession, rows: DataFrame, target: str) -> None:
    """INSERT INTO target (columns of the frame) by name."""
    names = ", ".join(quote(name) for name in rows.columns)
    spark.sql(f"INSERT INTO {relation(target)} ({names}) SELECT {names} FROM {{rows}}", rows=rows)
