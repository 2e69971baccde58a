"""Expressions generated from a schema, which reach every value inside structs, arrays, maps and variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A scalar of JSON text, or a key together with its colon.
_JSON_ITEM = r'"(?:[^"\\]|\\.)*":?|true|false|[-0-9][-+.eE0-9]*'


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def holds_variant(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return any(holds_variant(field.dataType) for field in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return holds_variant(data_type.elementType)
    return isinstance(data_type, T.VariantType) or isinstance(data_type, T.MapType) and holds_variant(data_type.valueType)


def leaf_total(value: Column, data_type: T.DataType, weight: Callable[[Column, T.DataType], Column]) -> Column:
    """Sum of ``weight`` over all scalars inside a value; a NULL part adds nothing."""

    def summed(items: Column, item_type: T.DataType) -> Column:
        total = F.aggregate(items, F.lit(0), lambda so_far, item: so_far + leaf_total(item, item_type, weight))
        return F.coalesce(total, F.lit(0))

    if isinstance(data_type, T.StructType):
        total = F.lit(0)
        for field in data_type.fields:
            total = total + leaf_total(value[field.name], field.dataType, weight)
        return F.when(value.isNotNull(), total).otherwise(0)
    if isinstance(data_type, T.ArrayType):
        return summed(value, data_type.elementType)
    if isinstance(data_type, T.MapType):
        return summed(F.map_values(value), data_type.valueType)
    return F.when(value.isNotNull(), weight(value, data_type)).otherwise(0)


def _scalars(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.VariantType):
        # Keys end in a colon; the text of a value never does, because it ends in its quote.
        items = F.regexp_extract_all(F.to_json(value), F.lit(_JSON_ITEM), 0)
        return F.size(F.filter(items, lambda item: ~item.endswith(":")))
    return F.lit(1)


def leaf_count(value: Column, data_type: T.DataType) -> Column:
    """How many scalars a value holds that are not NULL, at any depth."""
    return leaf_total(value, data_type, _scalars)


def _not_finite(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 1).otherwise(0)
    return F.lit(0)


def has_not_finite(value: Column, data_type: T.DataType) -> Column:
    """Some number inside the value is NaN or infinite."""
    return leaf_total(value, data_type, _not_finite) > 0


def rewritten(
    value: Column,
    data_type: T.DataType,
    *,
    keep: Callable[[str | Column], bool | Column],
    scalar: Callable[[Column, T.DataType], Column],
) -> tuple[Column, T.DataType]:
    """A value without the fields and map keys that ``keep`` refuses, its scalars replaced; and its new type.

    ``keep`` gets a name (fields, decided once for all rows) or a column (map keys, decided per row).
    """
    if isinstance(data_type, T.StructType):
        fields, types = [], []
        for field in data_type.fields:
            if keep(field.name):
                inner, inner_type = rewritten(value[field.name], field.dataType, keep=keep, scalar=scalar)
                fields.append(inner.alias(field.name))
                types.append(T.StructField(field.name, inner_type, field.nullable))
        # A struct that lost all its fields is an empty map, so that it is still told apart from NULL.
        new_type = T.StructType(types) if fields else T.MapType(T.StringType(), T.StringType())
        rebuilt = F.struct(*fields) if fields else F.create_map().cast("map<string,string>")
        return F.when(value.isNotNull(), rebuilt), new_type
    if isinstance(data_type, T.ArrayType):
        new_type = rewritten(F.lit(None), data_type.elementType, keep=keep, scalar=scalar)[1]
        items = F.transform(value, lambda item: rewritten(item, data_type.elementType, keep=keep, scalar=scalar)[0])
        return items, T.ArrayType(new_type, data_type.containsNull)
    if isinstance(data_type, T.MapType):
        kept, new_type = value, rewritten(F.lit(None), data_type.valueType, keep=keep, scalar=scalar)[1]
        if isinstance(data_type.keyType, T.StringType):
            kept = F.map_filter(value, lambda key, _: keep(key))
        items = F.transform_values(kept, lambda _, item: rewritten(item, data_type.valueType, keep=keep, scalar=scalar)[0])
        return items, T.MapType(data_type.keyType, new_type, data_type.valueContainsNull)
    return scalar(value, data_type), data_type
