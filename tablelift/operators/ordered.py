"""Order-dependent values over logs whose hottest key may hold a third of all rows.

A plain window puts a whole key into one task. Here each key is cut into buckets
that follow the order (days, hours), the window runs inside a bucket, and one row
per bucket carries totals and last values over to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def running(
    frame: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    *,
    totals: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Add running totals and previous-row values per key.

    ``bucket`` must not decrease along ``order`` and must not be NULL. ``totals``
    maps a new column to the number it sums up to and including the row;
    ``previous`` maps a new column to the column whose value the row before had.
    The carried frame has one row per key and bucket; both sides are partitioned
    by exactly these, so the join needs no further shuffle of the log.
    """
    totals, previous = totals or {}, previous or {}
    cut = frame.withColumn(_BUCKET, bucket).withColumns({f"__add_{name}": value for name, value in totals.items()})
    group = [*keys, _BUCKET]
    inside = Window.partitionBy(*group).orderBy(*order)
    up_to_row = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"__local_{name}": F.sum(f"__add_{name}").over(up_to_row) for name in totals}
    carried = [F.sum(f"__add_{name}").alias(f"__sum_{name}") for name in totals]
    if previous:
        kept = F.struct(*[F.col(source).alias(name) for name, source in previous.items()])
        local["__local_previous"] = F.lag(kept).over(inside)
        carried.append(F.max_by(kept, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = {f"__offset_{name}": F.sum(f"__sum_{name}").over(before) for name in totals}
    if previous:
        offsets["__carried"] = F.lag("__last").over(across)
    per_bucket = cut.groupBy(*group).agg(*carried).withColumns(offsets).select(*group, *offsets)
    joined = cut.withColumns(local).join(per_bucket, group)
    result = [F.col(name) for name in frame.columns]
    for name in totals:
        result.append((F.col(f"__local_{name}") + F.coalesce(f"__offset_{name}", F.lit(0))).alias(name))
    if previous:
        row = F.coalesce("__local_previous", "__carried")
        result += [row[name].alias(name) for name in previous]
    return joined.select(*result)
