"""Checks a publish makes itself, because a Parquet insert makes neither of them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.functions.types import cast_type
from tablelift.plans.expressions import column
from tablelift.plans.plan import Plan


def _long(frame: DataFrame, counts: dict[str, Column], name: str) -> DataFrame:
    wide = frame.agg(*[F.count_if(value).alias(key) for key, value in counts.items()])
    return wide.unpivot([], list(counts), "column_name", name)


def null_violations(frame: DataFrame, required: list[str]) -> DataFrame:
    """NULLs per column that must not hold any. One pass, no shuffle of rows."""
    return _long(frame, {name: column(name).isNull() for name in required}, "null_rows")


# Whole-number bounds of the integral types.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _fits(value: Column, source: T.DataType, target: T.DataType) -> Column | None:
    """Whether a number is inside the target's range, where plain comparison can tell."""
    if not isinstance(source, T.NumericType):
        return None
    if isinstance(target, T.IntegralType):
        bound = 2 ** (_BITS[target.simpleString()] - 1)
        if isinstance(source, (T.FloatType, T.DoubleType)):
            return (value > float(-bound) - 1) & (value < float(bound))
        return value.cast("decimal(38,0)").between(F.lit(Decimal(-bound)), F.lit(Decimal(bound - 1)))
    if isinstance(target, T.DecimalType) and isinstance(source, (T.FloatType, T.DoubleType)):
        # Half a unit below the bound, a value still rounds up and out of range.
        return F.abs(value) < 10.0 ** (target.precision - target.scale) - 0.5 * 10.0**-target.scale
    return None


def is_lossy(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """The value does not survive the cast there and back.

    Range checks come first for numbers: try_cast raises and catches an exception
    per value that does not fit, which is slow when most do not.
    """
    fits = _fits(value, source, target)
    there = value.try_cast(target) if fits is None else F.when(fits, value).cast(target)
    return value.isNotNull() & ~there.try_cast(source).eqNullSafe(value)


def lossy_casts(source: DataFrame, plan: Plan) -> DataFrame:
    """Rows per CAST mapping whose value would change or not fit."""
    counts = {}
    for item in plan.mappings:
        if item.transformation.kind == "CAST":
            name = item.transformation.columns[0]
            target = cast_type(item.transformation.canonical_type, item.target_type)
            counts[item.target_column] = is_lossy(column(name), source.schema[name].dataType, target)
    return _long(source, counts, "lossy_rows")
