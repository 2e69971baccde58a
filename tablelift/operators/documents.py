"""Whole table documents: CHECK constraints, optional sub-scans, coverage of every facet, one nested row per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelift.functions.catalog import optional_bool, optional_text, pick, view_coverage
from tablelift.operators.catalog import mark_membership, richest
from tablelift.session import materialize

# SQL states by which a server says that a privilege is missing.
MISSING_PRIVILEGE = ("42501",)

#: Facets of a document that are scanned by a query of their own, and the warning when one may not be read.
SCANNED = {
    "columns": "COLUMNS_UNAVAILABLE",
    "keys": "KEY_CONSTRAINTS_UNAVAILABLE",
    "foreign_keys": "FOREIGN_KEYS_UNAVAILABLE",
    "check_constraints": "CHECK_CONSTRAINTS_UNAVAILABLE",
    "view_definition": "VIEW_DEFINITION_UNAVAILABLE",
    "partitioning": "PARTITIONING_UNAVAILABLE",
}


def check_constraints(rows: DataFrame) -> DataFrame:
    """CHECK rows as constraints: name, expression as written and what the server says of their validity.

    One row per table, name and expression; of repeated rows the richest stays.
    """
    flags = {
        "is_enforced": ("is_enforced", "conenforced"),
        "is_validated": ("is_validated", "convalidated"),
        "is_rely": ("is_rely", "rely"),
    }
    typed = rows.select(
        "table_id",
        optional_text(pick(rows, "constraint_name", "name")).alias("constraint_name"),
        F.coalesce(optional_text(_expression(rows)), F.lit("")).alias("expression"),
        *[optional_bool(pick(rows, *names)).alias(flag) for flag, names in flags.items()],
        optional_text(pick(rows, "comment", "constraint_comment")).alias("comment"),
    )
    return richest(typed, ["table_id", "constraint_name", "expression"])


def _expression(rows: DataFrame) -> Column:
    return pick(rows, "expression", "check_clause", "constraint_definition")


def is_readable_check(rows: DataFrame, dialect: str) -> Column:
    """A CHECK row that can be kept.

    PostgreSQL rows need an expression. Snowflake rows need a name and an expression that is more than white space, and
    have to name the table they are listed under.
    """
    expression = _expression(rows)
    if dialect != "snowflake":
        return F.coalesce(expression != "", F.lit(False))
    name = pick(rows, "constraint_name", "name")
    parts = [("constraint_catalog", "catalog_name"), ("constraint_schema", "schema_name"), ("constraint_table", "object_name")]
    own = F.lit(True)
    for given, wanted in parts:
        own = own & pick(rows, given).eqNullSafe(pick(rows, wanted))
    named = F.coalesce((name != "") & ~F.contains(name, F.lit("\x00")), F.lit(False))
    return own & named & optional_text(expression).isNotNull()


def scan_outcomes(tables: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One column per scanned facet: true if it was read, false if a privilege was missing.

    ``outcomes`` has a row (table_id, facet, sqlstate) per sub-scan that failed. Any other failure than a missing
    privilege makes the whole discovery fail, with the facet and the state in the error.
    """
    failed = outcomes.groupBy("table_id").agg(
        *[F.max(F.when(F.col("facet") == facet, F.col("sqlstate"))).alias(facet) for facet in SCANNED]
    )
    joined = tables.select("table_id").join(failed, "table_id", "left")
    values = {}
    for facet in SCANNED:
        state = F.col(facet)
        other = F.raise_error(F.concat(F.lit(f"Scan of {facet} failed with state "), state)).cast("boolean")
        values[facet] = F.when(state.isNull(), True).when(state.isin(*MISSING_PRIVILEGE), False).otherwise(other)
    return joined.select("table_id", *[value.alias(facet) for facet, value in values.items()])


def _only_row(tables: DataFrame) -> DataFrame:
    """Base rows, one per table; a table with several is malformed and fails the job."""
    others = [name for name in tables.columns if name != "table_id"]
    per_table = tables.groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(*others)).alias("base"))
    several = F.raise_error(F.concat(F.lit("Several base rows for table "), "table_id")).cast(per_table.schema["base"].dataType)
    return per_table.select("table_id", F.when(F.col("rows") == 1, F.col("base")).otherwise(several).alias("base")).select("table_id", "base.*")


def _gathered(lists: dict[str, tuple[DataFrame, list[Column]]], coverages: dict[str, DataFrame]) -> DataFrame:
    """Rows of every list as one ordered array per table, and the coverages beside them, each in a column of its own.

    All meet in one shuffle, row by row, and are collected behind it. An array is as long as the table has columns or constraints.
    """
    tall = None
    for name, (frame, order) in lists.items():
        fields = [column for column in frame.columns if column != "table_id"]
        part = frame.select("table_id", F.struct(F.struct(*order).alias("order"), F.struct(*fields).alias("item")).alias(name))
        tall = part if tall is None else tall.unionByName(part, allowMissingColumns=True)
    for name, frame in coverages.items():
        tall = tall.unionByName(frame.select("table_id", F.col("coverage").alias(name)), allowMissingColumns=True)
    arrays = [F.array_sort(F.collect_list(name)).alias(name) for name in lists]
    gathered = tall.repartition("table_id").groupBy("table_id").agg(*arrays, *[F.max(name).alias(name) for name in coverages])
    return gathered.withColumns({name: F.col(f"{name}.item") for name in lists})


def _named_first(*others: str) -> list[Column]:
    """Named constraints by name, nameless ones last."""
    name = F.col("constraint_name")
    return [name.isNull().alias("nameless"), F.coalesce(name, F.lit("")).alias("name"), *[F.col(other).alias(f"o{n}") for n, other in enumerate(others)]]


def _degraded(facet: Column, coverage: Column) -> Column:
    """Coverage of a facet: UNAVAILABLE if it was not read, COMPLETE if nothing is known against it."""
    return F.when(~facet, "UNAVAILABLE").otherwise(F.coalesce(coverage, F.lit("COMPLETE")))


def whole_documents(
    tables: DataFrame,
    outcomes: DataFrame,
    columns: DataFrame,
    column_coverage: DataFrame,
    keys: DataFrame,
    primary_coverage: DataFrame,
    unique_coverage: DataFrame,
    foreign: DataFrame,
    foreign_coverage: DataFrame,
    checks: DataFrame,
    check_coverage: DataFrame,
    views: DataFrame,
    partitions: DataFrame,
) -> DataFrame:
    """One nested row per table with everything that was read of it, what was not, and why.

    Facets that were not read have no members and coverage UNAVAILABLE; what a partial facet does hold is kept.
    ``tables`` are base rows of objects, ``outcomes`` as in ``scan_outcomes``. Coverage frames hold (table_id, coverage) where
    a facet had rows. ``partitions`` holds (table_id, is_partitioned, partitioning_expression, coverage).
    """
    base = _only_row(tables)
    is_view = F.col("object_type").isin("VIEW", "MATERIALIZED_VIEW")
    has_parts = F.col("object_type").isin("TABLE", "PARTITIONED_TABLE", "FOREIGN_TABLE")

    # Three-valued marks: false only where the list is complete.
    scanned = materialize(scan_outcomes(base, outcomes), "scanned")
    keys = keys.join(scanned.filter("keys"), "table_id", "left_semi")
    foreign = foreign.join(scanned.filter("foreign_keys"), "table_id", "left_semi")
    keyed = columns
    types = {"is_primary_key": ("p", primary_coverage), "is_unique_key": ("u", unique_coverage)}
    known = _mark_coverage(scanned, {**{mark: ("keys", coverage) for mark, (_, coverage) in types.items()}, "is_foreign_key": ("foreign_keys", foreign_coverage)})
    for mark, (kind, _) in types.items():
        members = keys.filter(F.col("constraint_type") == kind).select("table_id", F.explode("columns").alias("column_name"))
        # Written, so that no task holds the sorts of several marks, or of marks and lists, at once.
        keyed = materialize(mark_membership(keyed.drop(mark), members, known.select("table_id", F.col(mark).alias("coverage")), mark), mark)
    local = foreign.select("table_id", F.explode("local_columns").alias("column_name"))
    keyed = mark_membership(keyed.drop("is_foreign_key"), local, known.select("table_id", F.col("is_foreign_key").alias("coverage")), "is_foreign_key")
    keyed = materialize(keyed, "is_foreign_key")

    place = F.col("ordinal_position")
    by_place = [place.isNull().alias("unplaced"), F.coalesce(place, F.lit(0)).alias("place"), F.col("column_name").alias("name")]
    key_fields = [name for name in keys.columns if name not in ("table_id", "constraint_type")]
    lists = {
        "columns": (keyed, by_place),
        "primary_keys": (keys.filter("constraint_type = 'p'").select("table_id", *key_fields), _named_first("columns")),
        "unique_constraints": (keys.filter("constraint_type = 'u'").select("table_id", *key_fields), _named_first("columns")),
        "foreign_keys": (foreign, _named_first("local_columns", "referenced_columns")),
        "check_constraints": (checks, _named_first("expression")),
    }
    coverages = {
        "columns": column_coverage, "primary_key": primary_coverage, "unique_constraints": unique_coverage,
        "foreign_keys": foreign_coverage, "check_constraints": check_coverage,
    }
    wide = base.join(scanned.withColumnsRenamed({facet: f"read_{facet}" for facet in SCANNED}), "table_id")
    wide = wide.join(_gathered(lists, {f"c_{name}": frame for name, frame in coverages.items()}), "table_id", "left")
    wide = wide.join(views.select("table_id", "view_definition"), "table_id", "left")
    facts = partitions.select("table_id", "is_partitioned", "partitioning_expression", F.col("coverage").alias("c_partitioning"))
    wide = wide.join(facts, "table_id", "left")

    definition = F.when(is_view & F.col("read_view_definition"), F.col("view_definition"))
    reader = {"primary_key": "keys", "unique_constraints": "keys"}
    coverage = {name: _degraded(F.col(f"read_{reader.get(name, name)}"), F.col(f"c_{name}")) for name in coverages}
    coverage["comments"] = F.lit("COMPLETE")
    coverage["estimated_row_count"] = F.when(is_view, "NOT_APPLICABLE").otherwise("COMPLETE")
    coverage["view_definition"] = view_coverage("postgresql", F.col("object_type"), definition, F.lit(False))
    partial = F.coalesce("c_partitioning", F.lit("PARTIAL"))
    coverage["partitioning"] = F.when(~has_parts, "NOT_APPLICABLE").when(~F.col("read_partitioning"), "UNAVAILABLE").otherwise(partial)
    coverage["clustering"] = F.lit("NOT_APPLICABLE")

    unread = {facet: ~F.col(f"read_{facet}") for facet in SCANNED}
    unread["view_definition"] = coverage["view_definition"] == "UNAVAILABLE"
    unread["partitioning"] = has_parts & unread["partitioning"]
    codes = [F.when(unread[facet], code) for facet, code in SCANNED.items()]
    codes += [F.when(coverage[name] == "PARTIAL", f"{name.upper()}_PARTIAL") for name in (*coverages, "partitioning")]

    def shown(facet: str, name: str) -> Column:
        kind = wide.schema[name].dataType.simpleString()
        return F.when(F.col(f"read_{facet}"), F.coalesce(name, F.expr(f"CAST(array() AS {kind})"))).otherwise(F.expr(f"CAST(array() AS {kind})"))

    has_partitions = has_parts & F.col("read_partitioning")
    return wide.select(
        *base.columns,
        shown("columns", "columns").alias("columns"),
        F.get(shown("keys", "primary_keys"), F.lit(0)).alias("primary_key"),
        shown("keys", "unique_constraints").alias("unique_constraints"),
        shown("foreign_keys", "foreign_keys").alias("foreign_keys"),
        shown("check_constraints", "check_constraints").alias("check_constraints"),
        definition.alias("view_definition"),
        F.when(has_partitions, F.col("is_partitioned")).alias("is_partitioned"),
        F.when(has_partitions, F.col("partitioning_expression")).alias("partitioning_expression"),
        F.struct(*[value.alias(name) for name, value in coverage.items()]).alias("coverage"),
        F.array_sort(F.array_compact(F.array(*codes))).alias("warnings"),
    )


def _mark_coverage(scanned: DataFrame, marks: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Coverage of the facet behind each mark, a column per mark; written, because each mark reads it."""
    joined = scanned
    for mark, (_, coverage) in marks.items():
        joined = joined.join(coverage.select("table_id", F.col("coverage").alias(mark)), "table_id", "left")
    return materialize(joined.select("table_id", *[_degraded(F.col(facet), F.col(mark)).alias(mark) for mark, (facet, _) in marks.items()]), "mark-coverage")
