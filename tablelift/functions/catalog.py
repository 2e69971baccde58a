"""Scalar rules for raw catalog values. Unknown stays NULL, it never becomes a guess."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelift.functions.types import WHITE_SPACE, case
from tablelift.plans.expressions import column


def pick(frame: DataFrame, *names: str) -> Column:
    """The first of ``names`` the frame has, whatever its letter case; present but NULL still wins."""
    present = {name.lower(): name for name in frame.columns}
    for name in names:
        if name.lower() in present:
            return column(present[name.lower()])
    return F.lit(None).cast("string")


def has_field(frame: DataFrame, *names: str) -> bool:
    present = {name.lower() for name in frame.columns}
    return any(name.lower() in present for name in names)


def stripped(text: Column) -> Column:
    """Text without outer white space of any kind, line breaks and tabs too."""
    return F.btrim(text, F.lit(WHITE_SPACE))


@dataclass(frozen=True)
class Raw:
    """A raw catalog value as text, and the same text without outer white space.

    Rules below read one or the other, so that a value is stripped once however many rules look at it.
    """

    text: Column
    bare: Column


def raw(value: Column) -> Raw:
    text = value.cast("string")
    return Raw(text, stripped(text))


def text_of(value: Raw) -> Column:
    return F.when(value.bare != "", value.text)


# What a cast to a whole number takes, range aside: it skips control characters around the digits.
_WHOLE = r"\A[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*\z"


def whole_number_of(value: Raw) -> Column:
    """Text of another form is not cast at all: in ANSI mode a cast that fails throws and catches an exception per value."""
    return F.when(value.bare.rlike(_WHOLE), value.bare.try_cast("bigint"))


def flag_of(value: Raw, yes: Sequence[str], no: Sequence[str]) -> Column:
    word = F.lower(value.bare)
    return F.when(word.isin(list(yes)), True).when(word.isin(list(no)), False)


# Words that stand for true and false.
YES_WORDS, NO_WORDS = ("yes", "y", "true", "t", "1"), ("no", "n", "false", "f", "0")


def optional_text(value: Column) -> Column:
    """Blank becomes NULL, other text is kept exactly."""
    return text_of(raw(value))


def optional_int(value: Column) -> Column:
    """Whole numbers only, sign and outer blanks allowed; anything else is NULL."""
    return whole_number_of(raw(value))


def optional_nullable(value: Column) -> Column:
    """YES and NO only (and booleans, whose text is true or false)."""
    return flag_of(raw(value), ("yes",), ("no",))


def optional_bool(value: Column) -> Column:
    return flag_of(raw(value), YES_WORDS, NO_WORDS)


# Words that mark a generated or a plain column, per dialect.
GENERATED_WORDS = {
    "postgresql": (("always", "stored"), ("never", "")),
    "snowflake": (("virtual", "virtual_column"), ("column", "")),
}


def schema_class(dialect: str, name: Column) -> Column:
    """Kind of a schema. The longer prefix is tested first."""
    if dialect == "snowflake":
        return F.when(name == "INFORMATION_SCHEMA", "INFORMATION_SCHEMA").otherwise("USER")
    return (
        F.when(name == "pg_catalog", "POSTGRESQL_CATALOG")
        .when(name == "information_schema", "INFORMATION_SCHEMA")
        .when(name.startswith("pg_toast_temp_"), "POSTGRESQL_TOAST_TEMPORARY")
        .when((name == "pg_toast") | name.startswith("pg_toast_"), "POSTGRESQL_TOAST")
        .when(name.startswith("pg_temp_"), "POSTGRESQL_TEMPORARY")
        .otherwise("USER")
    )


def is_system_schema(dialect: str, name: Column) -> Column:
    return schema_class(dialect, name) != "USER"


def lookup(value: Column, names: dict[str, str], otherwise: str | None) -> Column:
    """Constant dictionary lookup."""
    branches = [(value == key, F.lit(name)) for key, name in names.items()]
    return case(branches, F.lit(otherwise).cast("string"))


# Object kinds by catalog code or table type.
OBJECT_TYPES = {
    "postgresql": {
        "r": "TABLE", "table": "TABLE", "base table": "TABLE", "p": "PARTITIONED_TABLE",
        "partitioned table": "PARTITIONED_TABLE", "v": "VIEW", "view": "VIEW", "m": "MATERIALIZED_VIEW",
        "materialized view": "MATERIALIZED_VIEW", "f": "FOREIGN_TABLE", "foreign table": "FOREIGN_TABLE",
        "external table": "EXTERNAL_TABLE",
    },
    "snowflake": {
        "base table": "TABLE", "table": "TABLE", "view": "VIEW", "materialized view": "MATERIALIZED_VIEW",
        "external table": "EXTERNAL_TABLE", "dynamic table": "DYNAMIC_TABLE", "foreign table": "FOREIGN_TABLE",
    },
}


def object_type(dialect: str, kind: Column, is_dynamic: Column | None = None) -> Column:
    """Object family; a dynamic table is one whatever its table type says."""
    named = lookup(F.lower(F.trim(kind)), OBJECT_TYPES[dialect], "UNKNOWN")
    return named if is_dynamic is None else F.when(is_dynamic, "DYNAMIC_TABLE").otherwise(named)


# PostgreSQL persistence codes and names.
_PERSISTENCE = {
    "p": "PERMANENT", "permanent": "PERMANENT", "u": "UNLOGGED", "unlogged": "UNLOGGED",
    "t": "TEMPORARY", "temporary": "TEMPORARY", "temp": "TEMPORARY",
}


def persistence_from_code(code: Column) -> Column:
    return lookup(F.lower(F.trim(code)), _PERSISTENCE, "UNKNOWN")


def persistence_from_flags(kind: Column, is_temporary: Column, is_transient: Column, object_kind: Column) -> Column:
    """Permanent only when both flags are definitely false and the kind of object is known."""
    return (
        F.when(F.coalesce(is_temporary, F.lit(False)) | (F.upper(F.trim(kind)) == "TEMPORARY TABLE"), "TEMPORARY")
        .when(is_transient, "TRANSIENT")
        .when(~is_temporary & ~is_transient & (object_kind != "UNKNOWN"), "PERMANENT")
        .otherwise("UNKNOWN")
    )


def estimated_rows(rows: Column, object_kind: Column) -> Column:
    """Non-negative whole numbers; views and unknown objects have no estimate."""
    whole = F.when((rows >= 0) & (rows == F.floor(rows)), rows).try_cast("bigint")
    return F.when(~object_kind.isin("VIEW", "UNKNOWN"), whole)


# One-letter codes of foreign keys, identity, generated columns and partitioning.
CODES = {
    "match_option": {"f": "FULL", "p": "PARTIAL", "s": "SIMPLE"},
    "rule": {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"},
    "identity_generation": {"a": "ALWAYS", "d": "BY DEFAULT"},
    "generation_kind": {"s": "STORED", "v": "VIRTUAL"},
    "partition_strategy": {"h": "HASH", "l": "LIST", "r": "RANGE"},
}


def decode(kind: str, code: Column) -> Column:
    return lookup(code, CODES[kind], "NONE" if kind == "generation_kind" else None)


def is_fixed_code(value: Column) -> Column:
    """Upper-case code of 1 to 64 characters."""
    return value.rlike(r"\A[A-Z][A-Z0-9_]{0,63}\z")


def view_coverage(dialect: str, object_kind: Column, definition: Column, is_secure: Column) -> Column:
    """COMPLETE when a definition may be shown, NOT_APPLICABLE when the object is no view."""
    if dialect == "snowflake":
        shown = ~F.coalesce(is_secure, F.lit(False)) & (F.trim(F.coalesce(definition, F.lit(""))) != "")
        return (
            F.when(object_kind == "VIEW", F.when(shown, "COMPLETE").otherwise("UNAVAILABLE"))
            .when(object_kind == "MATERIALIZED_VIEW", "UNAVAILABLE")
            .otherwise("NOT_APPLICABLE")
        )
    shown = F.when(definition.isNotNull(), "COMPLETE").otherwise("UNAVAILABLE")
    return F.when(object_kind.isin("VIEW", "MATERIALIZED_VIEW"), shown).otherwise("NOT_APPLICABLE")


def clustering_coverage(object_kind: Column, auto_clustering: Column) -> Column:
    """Auto-clustering arrives as text: yes/no known, NULL unavailable, anything else malformed."""
    flag = F.upper(F.trim(auto_clustering))
    return (
        F.when(object_kind.isin("VIEW", "EXTERNAL_TABLE"), "NOT_APPLICABLE")
        .when(auto_clustering.isNull(), "UNAVAILABLE")
        .when(flag.isin("YES", "NO"), "COMPLETE")
        .otherwise("PARTIAL")
    )


def partition_coverage(object_kind: Column, is_partitioned: Column, is_child: Column, has_helpers: Column) -> Column:
    """Without the server's helper functions partitioned tables and their children are only partly known."""
    return (
        F.when(~object_kind.isin("TABLE", "PARTITIONED_TABLE", "FOREIGN_TABLE"), "NOT_APPLICABLE")
        .when(is_partitioned.isNull() | is_child.isNull(), "PARTIAL")
        .when(has_helpers | ~(is_partitioned | is_child), "COMPLETE")
        .otherwise("PARTIAL")
    )
