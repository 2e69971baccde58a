"""Nested array types: follow element definitions to the innermost type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelift.session import materialize


def element_definitions(rows: DataFrame) -> DataFrame:
    """One definition per collection id; ids with contradicting or unreadable definitions are dropped."""
    readable = F.coalesce((F.col("collection_id") != "") & (F.col("data_type") != ""), F.lit(False))
    definition = F.struct("data_type", "element_id")
    return (
        rows.filter(readable)
        .groupBy("collection_id")
        .agg(F.min(definition).alias("low"), F.max(definition).alias("high"))
        .filter(F.col("low").eqNullSafe(F.col("high")))
        .select("collection_id", F.col("low.data_type").alias("data_type"), F.col("low.element_id").alias("element_id"))
    )


def array_chains(rows: DataFrame) -> DataFrame:
    """(collection_id, array_dimensions, element_native_type, is_malformed) of every definition.

    Pointers are doubled: round k lets every open chain jump 2^k definitions, so a
    chain of depth d takes log2(d) joins and no depth is cut off. When a round
    resolves nothing, whatever is still open runs in a circle. A chain that leaves
    the known definitions has neither dimensions nor type.
    """
    definitions = element_definitions(rows)
    ends = (F.lower(F.trim("data_type")) != "array") | (F.coalesce("element_id", F.lit("")) == "")
    state = materialize(
        definitions.select(
            "collection_id",
            F.when(~ends, F.col("element_id")).alias("next_id"),
            F.lit(1).alias("steps"),
            F.when(ends, F.col("data_type")).alias("element_native_type"),
        ),
        "array-chains",
    )
    open_chains = state.filter(F.col("next_id").isNotNull()).count()
    while open_chains:
        ahead = state.select(
            F.col("collection_id").alias("next_id"),
            F.lit(True).alias("known"),
            F.col("next_id").alias("ahead_id"),
            F.col("steps").alias("ahead_steps"),
            F.col("element_native_type").alias("ahead_type"),
        )
        jumping = state.filter(F.col("next_id").isNotNull()).join(ahead, "next_id", "left")
        jumped = jumping.select(
            "collection_id",
            F.col("ahead_id").alias("next_id"),
            (F.col("steps") + F.coalesce("ahead_steps", F.lit(0))).alias("steps"),
            F.col("ahead_type").alias("element_native_type"),
        )
        state = materialize(state.filter(F.col("next_id").isNull()).unionByName(jumped), "array-chains")
        still_open = state.filter(F.col("next_id").isNotNull()).count()
        if still_open == open_chains:
            break
        open_chains = still_open
    resolved = F.col("element_native_type").isNotNull()
    return state.select(
        "collection_id",
        F.when(resolved, F.col("steps")).alias("array_dimensions"),
        "element_native_type",
        F.col("next_id").isNotNull().alias("is_malformed"),
    )
