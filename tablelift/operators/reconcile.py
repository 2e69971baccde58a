"""Compare paired metrics check by check and roll them up into a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.operators.metrics import checks_frame, checks_of, source_metrics, target_metrics
from tablelift.plans.plan import Plan


def count_value(value: Column, data_type: T.DataType) -> Column:
    """A non-negative whole count, or NULL. Floats and booleans are never counts."""
    if isinstance(data_type, T.IntegralType):
        number = value.cast("bigint")
    elif isinstance(data_type, T.DecimalType):
        number = F.when(value == F.floor(value), value).try_cast("bigint")
    elif isinstance(data_type, T.StringType):
        number = F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value).try_cast("bigint")
    else:
        return F.lit(None).cast("bigint")
    return F.when(number >= 0, number)


def reconcile(checks: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per check. Missing or malformed metrics are UNAVAILABLE, extra ones ignored.

    ``source`` and ``target`` are (check_id, value). How they meet the checks is left to Spark, which knows the size
    of both: a caller may hand over frames with any number of other rows.
    """
    sides = []
    for frame, name in ((source, "source_value"), (target, "target_value")):
        value = count_value(F.col("value"), frame.schema["value"].dataType).alias(name)
        sides.append(frame.select("check_id", value))
    joined = checks.join(sides[0], "check_id", "left").join(sides[1], "check_id", "left")
    s, t = F.col("source_value"), F.col("target_value")
    status = F.when(s.isNull() | t.isNull(), "UNAVAILABLE").when(s == t, "MATCH").otherwise("MISMATCH")
    return joined.select(
        "check_id",
        "check_type",
        "source_column",
        "target_column",
        "source_value",
        "target_value",
        status.alias("status"),
        (t - s).alias("difference"),
    )


def report(checked: DataFrame, *, plan_version: int, by: tuple[str, ...] = ()) -> DataFrame:
    """FAILED on any mismatch, else INCOMPLETE on any unavailable check, else PASSED.

    One row, or one per ``by`` group when several runs are reported at once.
    """
    counts = checked.groupBy(*by).agg(
        *[
            F.sum((F.col("status") == status).cast("bigint")).alias(name)
            for status, name in (
                ("MATCH", "matched_count"),
                ("MISMATCH", "mismatched_count"),
                ("UNAVAILABLE", "unavailable_count"),
            )
        ]
    )
    overall = (
        F.when(F.col("mismatched_count") > 0, "FAILED")
        .when(F.col("unavailable_count") > 0, "INCOMPLETE")
        .otherwise("PASSED")
    )
    return counts.withColumn("status", overall).withColumn("plan_version", F.lit(plan_version))


def validate(
    source: DataFrame, target: DataFrame, plan: Plan, *, null_mode: str = "propagate", mode: str = "exact"
) -> DataFrame:
    """Paired metrics of a source and a target under a plan, reconciled.

    With ``mode="approx"`` distinct checks are estimates: their type becomes
    APPROX_DISTINCT_COUNT so that a match is never read as an exact one.
    """
    checked = reconcile(
        checks_frame(source.sparkSession, checks_of(plan)),
        source_metrics(source, plan, null_mode=null_mode, mode=mode),
        target_metrics(target, plan, mode=mode),
    )
    if mode == "exact":
        return checked
    kind = F.col("check_type")
    return checked.withColumn("check_type", F.when(kind == "DISTINCT_COUNT", "APPROX_DISTINCT_COUNT").otherwise(kind))
