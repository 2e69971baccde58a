"""Bulk normalization of raw catalog rows: columns, objects, facets and table documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelift.functions.catalog import (
    GENERATED_WORDS,
    NO_WORDS,
    YES_WORDS,
    Raw,
    decode,
    estimated_rows,
    flag_of,
    has_field,
    is_system_schema,
    object_type,
    optional_bool,
    optional_text,
    partition_coverage,
    persistence_from_code,
    persistence_from_flags,
    pick,
    schema_class,
    stripped,
    text_of,
    whole_number_of,
)
from tablelift.functions.json import canonical_row, richness
from tablelift.functions.types import decimal_digits, dialect_key, element_type, family_of_key, native_type_key, scaled_family

# Databases that belong to the server.
SYSTEM_DATABASES = {
    "mysql": ("information_schema", "mysql", "performance_schema", "sys"),
    "sqlserver": ("master", "model", "msdb", "tempdb"),
}


def user_databases(databases: DataFrame, dialect: str) -> DataFrame:
    """Databases a user may pick: system ones and PostgreSQL templates are left out."""
    if dialect == "postgresql":
        databases = databases.filter(~F.coalesce(optional_bool(pick(databases, "datistemplate")), F.lit(False)))
    elif dialect in SYSTEM_DATABASES:
        databases = databases.filter(~F.lower("name").isin(list(SYSTEM_DATABASES[dialect])))
    return databases.select("name").orderBy("name")


def base_tables(tables: DataFrame, schema: str) -> DataFrame:
    """Base tables of one schema, by name."""
    kept = tables.filter((F.col("schema_name") == schema) & (F.upper("table_type") == "BASE TABLE"))
    return kept.select("table_name").orderBy("table_name")


def schemas(namespaces: DataFrame, roles: DataFrame | None, dialect: str) -> DataFrame:
    """Schemas with owner, kind and system flag. Roles without a schema are ignored.

    Without ``roles`` the rows hold the owner themselves, and a schema without one is kept.
    """
    name = F.col("schema_name")
    if roles is None:
        owned = namespaces.withColumn("owner", optional_text(pick(namespaces, "schema_owner", "owner")))
    else:
        owned = namespaces.join(roles, "owner_id")
    return owned.select(
        "catalog_name",
        "schema_name",
        "owner",
        schema_class(dialect, name).alias("schema_classification"),
        is_system_schema(dialect, name).alias("is_system_managed"),
    )


def objects(rows: DataFrame, dialect: str, object_types: Sequence[str] | None = None) -> DataFrame:
    """Objects with type, persistence and row estimate, one per (catalog, schema, name, type).

    The filter applies after the type is known, because a dynamic table hides
    behind an ordinary table type. An empty filter gives an empty result.
    """
    if dialect == "postgresql":
        kind = object_type(dialect, pick(rows, "relkind", "object_type", "table_type"))
        persistence = persistence_from_code(pick(rows, "relpersistence", "persistence"))
    else:
        table_type = pick(rows, "table_type", "object_type")
        temporary, transient = (optional_bool(pick(rows, name)) for name in ("is_temporary", "is_transient"))
        kind = object_type(dialect, table_type, optional_bool(pick(rows, "is_dynamic")))
        persistence = persistence_from_flags(table_type, temporary, transient, kind)
    typed = rows.select(
        "catalog_name",
        "schema_name",
        "object_name",
        kind.alias("object_type"),
        persistence.alias("persistence"),
        optional_text(pick(rows, "owner")).alias("owner"),
        estimated_rows(pick(rows, "estimated_row_count", "row_count", "reltuples"), kind).alias("estimated_row_count"),
    )
    if object_types is not None:
        typed = typed.filter(F.col("object_type").isin(list(object_types)) if object_types else F.lit(False))
    return richest(typed, ["catalog_name", "schema_name", "object_name", "object_type"])


def richest(rows: DataFrame, identity: list[str]) -> DataFrame:
    """One row per identity: most values first, then the smallest canonical JSON.

    An aggregate, not a ranking window. Rows meet as they are and their JSON is made there: folded
    before, each would be sorted and sent with its JSON beside it.
    """
    others = [name for name in rows.columns if name not in identity]
    rows = rows.repartition(*identity)
    preference = F.struct((-richness(rows)).alias("richness"), canonical_row(rows).alias("text"))
    best = rows.groupBy(*identity).agg(F.min_by(F.struct(*others), preference).alias("kept"))
    return best.select(*identity, *[F.col("kept")[name].alias(name) for name in others]).select(*rows.columns)


# Names under which catalogs carry a field, the first one present wins.
_COLUMN_FIELDS = {
    "catalog_name": ("catalog_name", "table_catalog"),
    "schema_name": ("schema_name", "table_schema"),
    "column_name": ("column_name",),
    "ordinal_position": ("ordinal_position",),
    "native": ("data_type", "native_type"),
    "nullable": ("is_nullable", "nullable"),
    "character_length": ("character_maximum_length", "character_length"),
    "precision": ("numeric_precision",),
    "radix": ("numeric_precision_radix",),
    "scale": ("numeric_scale",),
    "datetime_precision": ("datetime_precision",),
    "default": ("column_default", "default_expression", "default"),
    "comment": ("column_comment", "comment"),
    "collation": ("collation_name", "collation"),
    "identity": ("is_identity", "identity"),
    "identity_generation": ("identity_generation",),
    "extra": ("extra",),
    "generated": ("is_generated", "generated", "kind"),
    "generation_expression": ("generation_expression", "generated_expression", "expression"),
    "is_primary_key": ("is_primary_key",),
    "is_foreign_key": ("is_foreign_key",),
    "is_unique_key": ("is_unique_key", "unique_key"),
    "array_dimensions": ("array_dimensions", "attndims"),
    "element": ("element_native_type", "array_element_type"),
    "element_canonical": ("element_canonical_type", "array_element_canonical_type"),
}


def normalize_columns(rows: DataFrame, dialect: str) -> DataFrame:
    """Raw catalog column rows of one dialect as canonical columns."""
    return normalize_catalogs(rows.withColumn("dialect", F.lit(dialect)), (dialect,))


def normalize_catalogs(rows: DataFrame, dialects: Sequence[str] = ("postgresql", "mysql", "snowflake")) -> DataFrame:
    """Raw column rows of several dialects, told apart by ``dialect``, as canonical columns in one pass.

    Every field is stripped once, then each canonical column is one rule for all dialects; where they differ,
    the row's dialect is part of a key or of a condition. Rows of other dialects are left out.
    """
    kept = rows.filter(F.col("dialect").isin(*dialects))
    fields = []
    for name, names in _COLUMN_FIELDS.items():
        if has_field(rows, *names):
            value = pick(rows, *names).cast("string")
            fields += [value.alias(name), stripped(value).alias(f"{name}_bare")]
    bare = kept.select("dialect", "table_id", *fields)
    present = set(bare.columns)
    none = F.lit(None).cast("string")
    value = {name: Raw(F.col(name), F.col(f"{name}_bare")) if name in present else Raw(none, none) for name in _COLUMN_FIELDS}

    dialect = F.col("dialect")
    whole = {
        name: whole_number_of(value[name]).alias(name)
        for name in ("ordinal_position", "character_length", "precision", "radix", "scale", "datetime_precision", "array_dimensions")
    }
    # Every step names the one before more than once, so each is a projection of its own and is evaluated once.
    typed = bare.withColumns({f"{name}_number": number for name, number in whole.items()})
    natives = ("native", "element")
    typed = typed.withColumns({f"{name}_key": native_type_key(value[name].bare) for name in natives})
    typed = typed.withColumns({f"{name}_key": dialect_key(dialect, F.col(f"{name}_key"), dialects) for name in natives})
    typed = typed.withColumns({f"{name}_family": family_of_key(F.col(f"{name}_key"), dialects) for name in natives})
    typed = typed.withColumns({
        "canonical_type": scaled_family(F.col("native_family"), F.col("scale_number")),
        "element_family": F.when(value["element"].bare != "", scaled_family(F.col("element_family"), F.lit(None).cast("int"))),
    })
    digits = decimal_digits(F.col("canonical_type"), F.col("precision_number"), F.col("radix_number"))
    precision = F.when(dialect == "postgresql", digits).otherwise(F.col("precision_number"))

    def number(name: str) -> Column:
        return F.col(f"{name}_number").cast("int")

    def flag(name: str) -> Column:
        return flag_of(value[name], YES_WORDS, NO_WORDS)

    identity = flag("identity")
    extra, default = F.lower(F.coalesce(value["extra"].text, F.lit(""))), value["default"].text
    from_sequence = F.coalesce(default.like("nextval(%"), F.lit(False))
    is_auto_increment = (
        F.when(dialect == "mysql", F.contains(extra, F.lit("auto_increment")))
        .when(dialect == "postgresql", F.coalesce(identity, F.lit(False)) | from_sequence)
        .otherwise(identity)
    )
    is_generated = F.when(dialect == "mysql", F.contains(extra, F.lit("generated")))
    for name, words in GENERATED_WORDS.items():
        is_generated = is_generated.when(dialect == name, F.coalesce(flag("generated"), flag_of(value["generated"], *words)))
    return typed.select(
        dialect.alias("system"),
        "table_id",
        *[text_of(value[name]).alias(name) for name in ("catalog_name", "schema_name", "column_name")],
        number("ordinal_position").alias("ordinal_position"),
        text_of(value["native"]).alias("native_type"),
        "canonical_type",
        flag_of(value["nullable"], ("yes",), ("no",)).alias("nullable"),
        number("character_length").alias("character_length"),
        precision.cast("int").alias("numeric_precision"),
        number("scale").alias("numeric_scale"),
        number("datetime_precision").alias("datetime_precision"),
        text_of(value["default"]).alias("default_expression"),
        *[text_of(value[name]).alias(name) for name in ("comment", "collation", "identity_generation", "generation_expression")],
        F.when(dialect != "mysql", identity).alias("is_identity"),
        is_auto_increment.alias("is_auto_increment"),
        is_generated.alias("is_generated"),
        *[flag(name).alias(name) for name in ("is_primary_key", "is_foreign_key", "is_unique_key")],
        number("array_dimensions").alias("array_dimensions"),
        text_of(value["element"]).alias("element_native_type"),
        element_type(value["element_canonical"].bare, F.col("element_family")).alias("element_canonical_type"),
    )


def is_readable_column() -> Column:
    """A column row that can be kept: name, positive ordinal and type are there."""
    return (
        F.coalesce(F.col("column_name") != "", F.lit(False))
        & F.coalesce(F.col("ordinal_position") > 0, F.lit(False))
        & F.coalesce(F.col("native_type") != "", F.lit(False))
    )


def quarantine(rows: DataFrame, readable: Column, warning: str) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, coverage per table): bad rows are dropped and their table becomes PARTIAL."""
    flagged = rows.withColumn("readable", F.coalesce(readable, F.lit(False)))
    coverage = flagged.groupBy("table_id").agg(F.bool_and("readable").alias("complete")).select(
        "table_id",
        F.when(F.col("complete"), "COMPLETE").otherwise("PARTIAL").alias("coverage"),
        F.when(~F.col("complete"), F.lit(warning)).alias("warning"),
    )
    return flagged.filter("readable").drop("readable"), coverage


def facet_coverage(tables: DataFrame, facet: DataFrame | None, *, known: str = "COMPLETE") -> DataFrame:
    """Coverage of one facet for every table: not read UNAVAILABLE, read and empty COMPLETE.

    ``known`` caps what complete membership can prove, where the server reports
    less about the constraints themselves.
    """
    if facet is None:
        return tables.select("table_id", F.lit("UNAVAILABLE").alias("coverage"))
    return tables.select("table_id").join(facet.select("table_id", "coverage"), "table_id", "left").select(
        "table_id",
        F.when(F.col("coverage").isNull(), "COMPLETE")
        .when(F.col("coverage") == "COMPLETE", known)
        .otherwise(F.col("coverage"))
        .alias("coverage"),
    )


def facet_coverages(tables: DataFrame, facets: dict[str, DataFrame | None], *, known: str = "COMPLETE") -> DataFrame:
    """One column of ``facet_coverage`` per facet. All facets meet the tables in one join."""
    together = None
    for name, frame in facets.items():
        if frame is not None:
            part = frame.select("table_id", F.lit(name).alias("facet"), "coverage")
            together = part if together is None else together.unionByName(part)
    result = tables.select("table_id")
    if together is not None:
        read = [name for name, frame in facets.items() if frame is not None]
        wide = together.groupBy("table_id").agg(*[F.max(F.when(F.col("facet") == name, F.col("coverage"))).alias(name) for name in read])
        result = result.join(wide, "table_id", "left")
    values = {}
    for name, frame in facets.items():
        found = F.coalesce(name, F.lit("COMPLETE")) if frame is not None else F.lit("UNAVAILABLE")
        values[name] = F.when(found == "COMPLETE", known if frame is not None and known != "COMPLETE" else "COMPLETE").otherwise(found)
    return result.select("table_id", *[value.alias(name) for name, value in values.items()])


# Object fields whose presence in the catalog rows proves a facet was read.
_FACET_FIELDS = {
    "comments": ("comment", "table_comment", "object_comment"),
    "estimated_row_count": ("estimated_row_count", "row_count", "reltuples"),
    "partitioning": ("is_partitioned", "partitioning_expression"),
}


def default_facets(rows: DataFrame, object_kind: Column, results: dict[str, DataFrame | None]) -> DataFrame:
    """Coverage per facet when only presence is known.

    ``results`` holds the constraint result sets by facet, None for one that was
    not read. An object field counts as read when the rows have it, even as NULL.
    """
    facets = {"columns": F.lit("COMPLETE")}
    for name, frame in results.items():
        facets[name] = F.lit("UNAVAILABLE" if frame is None else "COMPLETE")
    for name, fields in _FACET_FIELDS.items():
        facets[name] = F.lit("COMPLETE" if has_field(rows, *fields) else "UNAVAILABLE")
    view = "COMPLETE" if has_field(rows, "view_definition") else "UNAVAILABLE"
    facets["view_definition"] = F.when(object_kind.isin("VIEW", "MATERIALIZED_VIEW"), view).otherwise("NOT_APPLICABLE")
    clustered = has_field(rows, "clustering_expression", "clustering_key")
    facets["clustering"] = F.lit("COMPLETE" if clustered else "NOT_APPLICABLE")
    return rows.select("table_id", *[value.alias(name) for name, value in facets.items()])


def warnings(*coverages: DataFrame) -> DataFrame:
    """Sorted distinct warning codes per table."""
    codes = coverages[0].select("table_id", "warning")
    for frame in coverages[1:]:
        codes = codes.unionByName(frame.select("table_id", "warning"))
    return codes.filter(F.col("warning").isNotNull()).groupBy("table_id").agg(
        F.array_sort(F.collect_set("warning")).alias("warnings")
    )


def partitions(classes: DataFrame, inheritance: DataFrame, strategies: DataFrame, has_helpers: bool) -> DataFrame:
    """Partition facts. A partitioned table has its own strategy, a child that of its parent."""
    links = inheritance.select(F.col("child_id").alias("relation_id"), "parent_id", "partition_bound")
    # The key of the second join depends on the row; computed first, it is an equi-join.
    keyed = classes.join(links, "relation_id", "left").withColumn(
        "strategy_id", F.when(F.col("relkind") == "p", F.col("relation_id")).otherwise(F.col("parent_id"))
    )
    # Rows without a strategy meet none; a number of their own keeps them from being one task's.
    keyed = keyed.withColumn("__spread", F.when(F.col("strategy_id").isNull(), F.xxhash64("relation_id")).otherwise(F.lit(0).cast("bigint")))
    # No constant, which would be taken out of the join.
    own = strategies.withColumn("__spread", F.when(F.col("strategy_id").isNull(), F.xxhash64("strategy_id")).otherwise(F.lit(0).cast("bigint")))
    facts = keyed.join(own, ["strategy_id", "__spread"], "left")
    is_partitioned, is_child = F.col("relkind") == "p", F.col("parent_id").isNotNull()
    kind = object_type("postgresql", F.col("relkind"))
    helpers = F.lit(has_helpers)
    return facts.select(
        "relation_id",
        is_partitioned.alias("is_partitioned"),
        is_child.alias("is_partition_child"),
        "parent_id",
        decode("partition_strategy", F.col("partstrat")).alias("partition_strategy"),
        F.when(helpers, F.col("partition_key")).alias("partitioning_expression"),
        F.when(is_child, F.col("partition_bound")).alias("partition_bound"),
        partition_coverage(kind, is_partitioned, is_child, helpers).alias("coverage"),
    )


def live_columns(attributes: DataFrame, defaults: DataFrame, collations: DataFrame) -> DataFrame:
    """Live attributes with their default expression and collation, where they have one."""
    live = attributes.filter((F.col("attnum") > 0) & ~F.col("attisdropped"))
    return live.join(defaults, ["relation_id", "attnum"], "left").join(collations, "collation_id", "left")


def mark_membership(columns: DataFrame, members: DataFrame, coverage: DataFrame, name: str) -> DataFrame:
    """Flag columns that belong to a constraint: true if listed, false only if the list is complete."""
    listed = members.select("table_id", "column_name").distinct().withColumn("listed", F.lit(True))
    # By table first: columns then lie with their table for the second join, and for the marks of other constraints.
    joined = columns.join(coverage.select("table_id", F.col("coverage").alias("list_coverage")), "table_id", "left")
    joined = joined.join(listed, ["table_id", "column_name"], "left")
    flag = F.when(F.col("listed"), True).when(F.col("list_coverage") == "COMPLETE", False)
    return joined.withColumn(name, flag).drop("listed", "list_coverage")
