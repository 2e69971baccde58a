"""Apply an approved plan: one narrow ``select`` from source to target shape."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelift.plans.expressions import to_column
from tablelift.plans.plan import Approval, Plan


def mapped_value(plan: Plan, mapping: Approval, *, null_mode: str = "propagate") -> Column:
    """The value a mapping produces, in the target column's type when that is known."""
    value = to_column(
        mapping.transformation, plan.source_columns, target_type=mapping.target_type, null_mode=null_mode
    )
    return value if mapping.target_type is None else value.cast(mapping.target_type)


def project(source: DataFrame, plan: Plan, *, null_mode: str = "propagate") -> DataFrame:
    """Target-shaped frame, columns in target order. Narrow: no shuffle, inside codegen."""
    return source.select(
        [mapped_value(plan, item, null_mode=null_mode).alias(item.target_column) for item in plan.mappings]
    )


def preview(source: DataFrame, plan: Plan, rows: int, *, null_mode: str = "propagate") -> DataFrame:
    """The first rows a publish would write."""
    return project(source, plan, null_mode=null_mode).limit(rows)


def unique_names(names: Sequence[str]) -> list[str]:
    """Make result names unique: id, id, name, id becomes id, id_2, name, id_3."""
    result: list[str] = []
    for name in names:
        candidates = itertools.chain([name], (f"{name}_{number}" for number in itertools.count(2)))
        result.append(next(item for item in candidates if item not in result))
    return result


def with_unique_names(frame: DataFrame) -> DataFrame:
    return frame.toDF(*unique_names(frame.columns))


def null_out(frame: DataFrame, name: str, value: object) -> DataFrame:
    """Replace one value of one column by NULL (``nullif``)."""
    return frame.withColumn(name, F.nullif(F.col(name), F.lit(value)))
