"""Canonical type families, native-type lookup and Spark type choice."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space at the ends of a catalog value.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Canonical type families.
CANONICAL_TYPES = (
    "STRING",
    "INTEGER",
    "DECIMAL",
    "FLOAT",
    "BOOLEAN",
    "DATE",
    "TIME",
    "TIMESTAMP",
    "TIMESTAMP_TZ",
    "BINARY",
    "SEMI_STRUCTURED",
    "UNKNOWN",
)

# Native type names per dialect and the family each belongs to.
# "FIXED_POINT" is INTEGER when the scale is exactly 0 and DECIMAL otherwise.
NATIVE_TYPES = {
    "postgresql": {
        "STRING": ["character", "character varying", "varchar", "char", "text", "citext", "name", "uuid", "bpchar"],
        "INTEGER": ["smallint", "integer", "bigint", "smallserial", "serial", "bigserial", "int2", "int4", "int8"],
        "FIXED_POINT": ["numeric", "decimal"],
        "FLOAT": ["real", "double precision", "float", "float4", "float8"],
        "BOOLEAN": ["boolean", "bool"],
        "DATE": ["date"],
        "TIME": ["time", "time without time zone", "time with time zone", "timetz"],
        "TIMESTAMP": ["timestamp", "timestamp without time zone"],
        "TIMESTAMP_TZ": ["timestamp with time zone", "timestamptz"],
        "BINARY": ["bytea"],
        "SEMI_STRUCTURED": ["json", "jsonb", "xml", "hstore", "array"],
    },
    "mysql": {
        "STRING": ["char", "varchar", "text", "tinytext", "mediumtext", "longtext", "enum", "set"],
        "INTEGER": ["tinyint", "smallint", "mediumint", "int", "integer", "bigint", "year"],
        "FIXED_POINT": ["decimal", "numeric"],
        "FLOAT": ["float", "double", "real"],
        "BOOLEAN": ["bool", "boolean"],
        "DATE": ["date"],
        "TIME": ["time"],
        "TIMESTAMP": ["datetime", "timestamp"],
        "BINARY": ["binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob", "bit"],
        "SEMI_STRUCTURED": ["json"],
    },
    "snowflake": {
        "STRING": ["varchar", "char", "character", "string", "text"],
        "INTEGER": ["integer", "int", "bigint", "smallint", "tinyint", "byteint"],
        "FIXED_POINT": ["number", "numeric", "decimal", "dec", "fixed"],
        "FLOAT": ["float", "double", "double precision", "real", "float4", "float8"],
        "BOOLEAN": ["boolean"],
        "DATE": ["date"],
        "TIME": ["time"],
        "TIMESTAMP": ["timestamp", "timestamp_ntz", "datetime"],
        "TIMESTAMP_TZ": ["timestamp_tz", "timestamp_ltz"],
        "BINARY": ["binary", "varbinary"],
        "SEMI_STRUCTURED": ["variant", "object", "array"],
    },
    "spark": {
        "STRING": ["string", "char", "varchar"],
        "INTEGER": ["tinyint", "smallint", "int", "bigint"],
        "FIXED_POINT": ["decimal"],
        "FLOAT": ["float", "double"],
        "BOOLEAN": ["boolean"],
        "DATE": ["date"],
        "TIME": ["time"],
        "TIMESTAMP": ["timestamp_ntz"],
        "TIMESTAMP_TZ": ["timestamp"],
        "BINARY": ["binary"],
        "SEMI_STRUCTURED": ["variant"],
    },
}


_DIALECTS = tuple(NATIVE_TYPES)


def native_type_key(bare: Column) -> Column:
    """Matching-only name of a stripped native type: lower case, single spaces, no parenthesised dimensions."""
    spaced = F.regexp_replace(F.lower(bare), r"(?U)\s+", " ")
    return F.coalesce(F.btrim(F.regexp_replace(spaced, r" ?\([^)]*\)", "")), F.lit(""))


# Type names that stand for a whole pattern: arrays in PostgreSQL, nested types in Spark.
_PATTERNS = {"postgresql": (r"^.*\[\]$", "array"), "spark": (r"^(array|map|struct)<.*$", "variant")}


def dialect_key(dialect: Column, key: Column, dialects: Sequence[str] = _DIALECTS) -> Column:
    """Key of a native type in its dialect; names that follow a pattern become the name of the pattern."""
    name = key
    for one in sorted(set(dialects) & _PATTERNS.keys()):
        pattern, family = _PATTERNS[one]
        name = F.when((dialect == one) & key.rlike(pattern), family).otherwise(name)
    return F.concat(dialect, F.lit(":"), name)


def family_of_key(key: Column, dialects: Sequence[str] = _DIALECTS) -> Column:
    """Family of a dialect key, by one set of names per family; FIXED_POINT still depends on the scale."""
    names: dict[str, list[str]] = {}
    for dialect in dialects:
        for family, natives in NATIVE_TYPES[dialect].items():
            names.setdefault(family, []).extend(f"{dialect}:{native}" for native in natives)
    return case([(key.isin(keys), F.lit(family)) for family, keys in names.items()], F.lit("UNKNOWN"))


def scaled_family(family: Column, numeric_scale: Column) -> Column:
    fixed_point = F.when(numeric_scale == 0, "INTEGER").otherwise("DECIMAL")
    return F.when(family == "FIXED_POINT", fixed_point).otherwise(family)


def canonical_type(dialect: str, native: Column, numeric_scale: Column) -> Column:
    """Canonical family of a native type of one dialect; unknown names become UNKNOWN.

    One expression. Over many columns each of the steps above is better a column of its own, because a step
    names the one before several times.
    """
    key = dialect_key(F.lit(dialect), native_type_key(F.btrim(native, F.lit(WHITE_SPACE))), [dialect])
    return scaled_family(family_of_key(key, [dialect]), numeric_scale)


def case(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """``CASE WHEN`` from (condition, value) pairs, first hit wins."""
    (condition, value), *rest = branches
    result = F.when(condition, value)
    for condition, value in rest:
        result = result.when(condition, value)
    return result if otherwise is None else result.otherwise(otherwise)


def decimal_digits(canonical: Column, precision: Column, radix: Column) -> Column:
    """Binary integer precision (radix 2) as decimal digits: 16, 32, 64 give 5, 10, 19."""
    digits = (F.floor((precision - 1) * F.lit(math.log10(2))) + 1).cast("int")
    return F.when((canonical == "INTEGER") & (radix == 2) & (precision > 0), digits).otherwise(precision)


def element_type(explicit: Column, native: Column) -> Column:
    """Array element family: an explicit canonical name wins, else the family of the native type."""
    named = F.upper(explicit)
    return F.when(named.isin(list(CANONICAL_TYPES)), named).otherwise(native)


# Order in which compatibility classes are preferred, best first.
COMPATIBILITY_PRIORITY = {"EXACT": 4, "SAFE": 3, "LOSSY": 2, "UNKNOWN": 1, "INCOMPATIBLE": 0}

# Type classes of a column pair: (compatibility, dimensions proven).
TYPE_CLASSES = (
    ("INCOMPATIBLE", False),
    ("UNKNOWN", False),
    ("LOSSY", False),
    ("SAFE", False),
    ("SAFE", True),
    ("EXACT", False),
    ("EXACT", True),
)

DIMENSIONS = ("character_length", "numeric_precision", "numeric_scale", "datetime_precision")
_LARGEST = 2**31 - 1


def constants(values: list, element: str) -> Column:
    """A constant array."""
    return F.expr(f"CAST(array({', '.join(map(repr, values))}) AS array<{element}>)")


def _family_pair(source: str, target: str) -> int:
    """What two families allow before dimensions are compared; 4 and 5 depend on them."""
    if "UNKNOWN" in (source, target):
        return 1
    if source == target:
        return 5
    if (source, target) == ("INTEGER", "DECIMAL"):
        return 4
    if (source, target) == ("DATE", "TIMESTAMP"):
        return 3
    if (source, target) in (("DECIMAL", "INTEGER"), ("DECIMAL", "FLOAT"), ("INTEGER", "FLOAT")):
        return 2
    return 0


_FAMILY_PAIRS = [_family_pair(source, target) for source in CANONICAL_TYPES for target in CANONICAL_TYPES]



def family_pair(source: Column, target: Column) -> Column:
    """What the families of two columns allow, by family number; see ``_family_pair``."""
    return F.get(constants(_FAMILY_PAIRS, "int"), source * len(CANONICAL_TYPES) + target)


def viable_families(source: str) -> int:
    """Bits of the target families that a source family is compatible with."""
    return sum(1 << number for number, target in enumerate(CANONICAL_TYPES) if _family_pair(source, target))


TYPE_CODES = ("family", "known", *DIMENSIONS)


def type_codes(side: str) -> dict[str, Column]:
    """Integers that stand for a column's type: family number, known dimensions, dimensions.

    An unknown dimension becomes the value that can never narrow on its side, so
    pairs compare plain integers.
    """
    unknown = -1 if side == "source" else _LARGEST
    family = F.array_position(F.array(*[F.lit(name) for name in CANONICAL_TYPES]), F.col("canonical_type"))
    known = F.lit(0)
    for position, name in enumerate(DIMENSIONS):
        known = known + F.when(F.col(name).isNotNull(), 2**position).otherwise(0)
    return {
        "family": (F.coalesce(F.nullif(family, F.lit(0)), F.lit(len(CANONICAL_TYPES))) - 1).cast("int"),
        "known": known,
        **{name: F.coalesce(F.col(name).cast("int"), F.lit(unknown)) for name in DIMENSIONS},
    }


def type_class(source: dict[str, Column], target: dict[str, Column]) -> Column:
    """Index into ``TYPE_CLASSES`` for two sets of type codes."""
    pair = family_pair(source["family"], target["family"])
    narrows = F.lit(False)
    for name in DIMENSIONS:
        narrows = narrows | (target[name] < source[name])
    proven = F.when(source["known"].bitwiseAND(target["known"]) != 0, 1).otherwise(0)
    return F.when(pair < 4, pair).when(narrows, 2).when(pair == 4, 3 + proven).otherwise(5 + proven)


def compatibility_of(type_class_value: Column) -> Column:
    return F.get(constants([name for name, _ in TYPE_CLASSES], "string"), type_class_value)


def priority_of(type_class_value: Column) -> Column:
    return F.get(constants([COMPATIBILITY_PRIORITY[name] for name, _ in TYPE_CLASSES], "int"), type_class_value)


class UnsupportedTypeError(ValueError):
    """A column whose family cannot be landed or cast without guessing."""


def landing_type(
    canonical: str,
    *,
    spark_type: T.DataType | None = None,
    precision: int | None = None,
    scale: int | None = None,
    datetime_precision: int | None = None,
    time_type: bool = False,
) -> T.DataType:
    """Spark type a staged column lands in: lossless, or text, or refused."""
    if canonical == "STRING" or canonical == "SEMI_STRUCTURED":
        return T.StringType()
    if canonical == "INTEGER":
        return spark_type if isinstance(spark_type, T.IntegralType) else T.DecimalType(38, 0)
    if canonical == "DECIMAL":
        fits = precision is not None and scale is not None and 1 <= precision <= 38 and 0 <= scale <= precision
        return T.DecimalType(precision, scale) if fits else T.StringType()
    if canonical == "FLOAT":
        return T.DoubleType()
    if canonical == "BOOLEAN":
        return T.BooleanType()
    if canonical == "DATE":
        return T.DateType()
    if canonical == "TIME":
        return T.TimeType(6) if time_type and (datetime_precision or 6) <= 6 else T.StringType()
    if canonical in ("TIMESTAMP", "TIMESTAMP_TZ"):
        if datetime_precision is not None and datetime_precision > 6:
            return T.StringType()
        return T.TimestampNTZType() if canonical == "TIMESTAMP" else T.TimestampType()
    if canonical == "BINARY":
        return T.BinaryType()
    raise UnsupportedTypeError(f"No lossless landing type for {canonical}.")


def cast_type(canonical: str, target: T.DataType | None = None) -> T.DataType:
    """Type of a CAST node: the target column's own type when it is of that family."""
    if target is not None and family_of(target) == canonical:
        return target
    if target is not None and canonical == "DECIMAL" and isinstance(target, T.DecimalType):
        return target
    if canonical == "DECIMAL":
        return T.DecimalType(38, 18)
    return landing_type(canonical)


def family_of(data_type: T.DataType) -> str:
    """Canonical family of a Spark type."""
    if isinstance(data_type, T.DecimalType):
        return "INTEGER" if data_type.scale == 0 else "DECIMAL"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    if isinstance(data_type, T.IntegralType):
        return "INTEGER"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "FLOAT"
    if isinstance(data_type, T.TimestampNTZType):
        return "TIMESTAMP"
    if isinstance(data_type, T.TimestampType):
        return "TIMESTAMP_TZ"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "SEMI_STRUCTURED"
    for kind, name in ((T.BooleanType, "BOOLEAN"), (T.DateType, "DATE"), (T.TimeType, "TIME"), (T.BinaryType, "BINARY")):
        if isinstance(data_type, kind):
            return name
    return "UNKNOWN"
