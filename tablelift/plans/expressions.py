"""The closed transformation grammar and its compilation to ``Column`` expressions."""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.functions.types import CANONICAL_TYPES, cast_type

MAX_DEPTH = 16


class InvalidPlanError(ValueError):
    """A plan or expression that must not reach Spark."""


def column(name: str) -> Column:
    """Reference one column by its exact name, whatever characters it holds."""
    return F.col(quote(name))


def quote(name: str) -> str:
    if not isinstance(name, str) or not name.strip() or "\x00" in name:
        raise InvalidPlanError("Column names must be non-blank text without NUL.")
    return "`" + name.replace("`", "``") + "`"


def is_safe_literal(value: Any) -> bool:
    """NULL, text, booleans, integers, dates and times, and finite numbers."""
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, decimal.Decimal):
        return value.is_finite()
    return value is None or isinstance(value, (str, bool, int, datetime.date, datetime.datetime, datetime.time))


@dataclass(frozen=True)
class Expr:
    """One node of the grammar. Build nodes with the functions below."""

    kind: str
    columns: tuple[str, ...] = ()
    value: Any = None
    canonical_type: str | None = None
    arguments: tuple["Expr", ...] = ()
    separator: str | None = None

    def __post_init__(self) -> None:
        for name in self.columns:
            quote(name)
        if len(set(self.columns)) != len(self.columns):
            raise InvalidPlanError("An expression may name each source column once.")
        inputs = len(self.columns) + len(self.arguments)
        well_formed = {
            "DIRECT_COPY": len(self.columns) == 1 and inputs == 1,
            "SOURCE_COLUMN": len(self.columns) == 1 and inputs == 1,
            "CAST": len(self.columns) == 1 and inputs == 1 and self.canonical_type in CANONICAL_TYPES,
            "CONCAT": len(self.columns) >= 2 and not self.arguments,
            "COALESCE": inputs >= 2,
            "LITERAL": inputs == 0 and is_safe_literal(self.value),
        }
        if not well_formed.get(self.kind, False):
            raise InvalidPlanError(f"Not a valid {self.kind} expression.")
        if self.kind != "LITERAL" and self.value is not None:
            raise InvalidPlanError("Only LITERAL carries a value.")


def copy_of(name: str) -> Expr:
    return Expr("DIRECT_COPY", (name,))


def source_column(name: str) -> Expr:
    return Expr("SOURCE_COLUMN", (name,))


def cast(name: str, canonical_type: str) -> Expr:
    return Expr("CAST", (name,), canonical_type=canonical_type)


def concat(*names: str, separator: str | None = None) -> Expr:
    return Expr("CONCAT", names, separator=separator)


def literal(value: Any) -> Expr:
    return Expr("LITERAL", value=value)


def coalesce(*inputs: str | Expr) -> Expr:
    """Columns first, then nested expressions, in the order given."""
    return Expr(
        "COALESCE",
        tuple(item for item in inputs if isinstance(item, str)),
        arguments=tuple(item for item in inputs if isinstance(item, Expr)),
    )


def to_column(
    expr: Expr,
    known_columns: Iterable[str],
    *,
    target_type: T.DataType | None = None,
    null_mode: str = "propagate",
    depth: int = 0,
) -> Column:
    """Compile a node. Unknown columns and trees of depth 16 or more are refused.

    ``null_mode`` decides CONCAT without a separator: "propagate" gives NULL when
    any input is NULL, "skip" leaves NULL inputs out.
    """
    known = frozenset(known_columns)
    if depth >= MAX_DEPTH:
        raise InvalidPlanError(f"Expressions may nest at most {MAX_DEPTH} levels.")
    unknown = [name for name in expr.columns if name not in known]
    if unknown:
        raise InvalidPlanError(f"Expression reads unknown columns: {unknown}")
    inputs = [column(name) for name in expr.columns]
    if expr.kind in ("DIRECT_COPY", "SOURCE_COLUMN"):
        return inputs[0]
    if expr.kind == "CAST":
        return inputs[0].cast(cast_type(expr.canonical_type, target_type))
    if expr.kind == "CONCAT":
        texts = [item.cast("string") for item in inputs]
        if expr.separator is not None:
            return F.concat_ws(expr.separator, *texts)
        return F.concat(*texts) if null_mode == "propagate" else F.concat_ws("", *texts)
    if expr.kind == "LITERAL":
        value = F.lit(expr.value)
        return value if target_type is None else value.cast(target_type)
    nested = [
        to_column(item, known, target_type=target_type, null_mode=null_mode, depth=depth + 1)
        for item in expr.arguments
    ]
    # One common type up front: with ANSI casts a text fallback next to a number would fail at run time.
    return F.coalesce(*[item if target_type is None else item.cast(target_type) for item in inputs + nested])


def columns_read(expr: Expr, *, nested: bool = True) -> tuple[str, ...]:
    """Source columns in first-use order; ``nested=False`` looks at the top node only."""
    names = list(expr.columns)
    if nested:
        for item in expr.arguments:
            names.extend(columns_read(item))
    return tuple(dict.fromkeys(names))


def to_dict(expr: Expr) -> dict[str, Any]:
    """Plain form for fingerprints and stored plans."""
    return {
        "kind": expr.kind,
        "columns": list(expr.columns),
        "value": None if expr.value is None else str(expr.value),
        "canonical_type": expr.canonical_type,
        "arguments": [to_dict(item) for item in expr.arguments],
        "separator": expr.separator,
    }
