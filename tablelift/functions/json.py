"""Canonical JSON text, fingerprints and redaction of sensitive keys."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.functions.nested import has_not_finite, holds_variant, is_nested, leaf_count, rewritten
from tablelift.plans.expressions import column

# Metadata keys that are never kept, compared after normalizing case and separators.
SENSITIVE_KEYS = (
    "access_token", "account_identifier", "api_key", "connection_string", "credential", "credentials",
    "driver_error", "dsn", "exception", "exception_repr", "host", "hostname", "passwd", "password",
    "private_key", "profile_json", "pwd", "raw_driver_error", "raw_exception", "raw_profile_json",
    "refresh_token", "secret", "stack_trace", "token", "traceback", "user", "username",
)


# Strings, or what stands between them; a number there that a variant would not keep digit by digit; and how such
# a number is hidden in a string. A string of the document's own that starts alike gets the mark a second time.
_PIECES = r'"(?:[^"\\]|\\.)*"|[^"]+'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_UNSAFE = r"[0-9]{16}|[0-9][.eE]|-0"
_MARK = r"\u0001"


def _hidden(text: Column) -> Column:
    """JSON text with every number as a marked string."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), 0)

    def piece(one: Column) -> Column:
        # Only an unescaped quote starts the mark; the escape may be written in either case of its digits.
        own = F.regexp_replace(one, r'^"(?=\\u0001)', '"' + r"\\u0001")
        return F.when(one.startswith('"'), own).otherwise(F.regexp_replace(one, f"(?<![0-9A-Za-z.+-]){_NUMBER}(?![0-9A-Za-z.+-])", '"' + r"\\u0001$0" + '"'))

    return F.array_join(F.transform(pieces, piece), "")


def _shown(text: Column) -> Column:
    """The inverse of ``_hidden`` on rendered text. A quote that opens a string never follows a backslash."""
    numbers = F.regexp_replace(text, r'(?<!\\)"\\u0001(-?[0-9][^"]*)"', "$1")
    return F.regexp_replace(numbers, r'(?<!\\)"\\u0001\\u0001', '"' + r"\\u0001")


def json_text(value: Column, data_type: T.DataType | None = None) -> Column:
    """Text is JSON already, nested values are rendered with all their fields."""
    if data_type is not None and not isinstance(data_type, T.StringType):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value


def canonical_json(value: Column, data_type: T.DataType | None = None) -> Column:
    """Compact JSON with sorted keys, numbers as they are written; NULL where ``json_issue`` names a reason.

    Numbers of up to fifteen digits pass through a variant as they are. Longer ones, fractions and exponents, of which a
    variant keeps the value only (or a part of it), are carried through as strings.
    """
    text = json_text(value, data_type)
    exact = _shown(F.to_json(F.try_parse_json(_hidden(text))))
    rendered = F.when(text.rlike(_UNSAFE), exact).otherwise(F.to_json(F.try_parse_json(text)))
    if data_type is None or not is_nested(data_type) or isinstance(data_type, T.VariantType):
        return rendered
    return F.when(~has_not_finite(value, data_type), rendered)


def json_issue(value: Column, data_type: T.DataType | None = None, canonical: Column | None = None) -> Column:
    """Why a value has no canonical JSON: NOT_FINITE, or UNREADABLE_JSON (malformed text, a key twice); else NULL.

    ``canonical`` is the value's canonical JSON where a column holds it already.
    """
    canonical = canonical_json(value, data_type) if canonical is None else canonical
    unreadable = F.when(value.isNotNull() & canonical.isNull(), "UNREADABLE_JSON")
    if data_type is None or not is_nested(data_type) or isinstance(data_type, T.VariantType):
        return unreadable
    return F.when(has_not_finite(value, data_type), "NOT_FINITE").otherwise(unreadable)


def fingerprint(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, as lower-case hex."""
    return F.sha2(text, 256)


def request_hash(command: str, request: Column) -> Column:
    """Fingerprint that binds the command name to its canonical JSON request."""
    return fingerprint(F.concat(F.lit('{"command_type":"' + command + '","request":'), request, F.lit("}")))


def normalized_key(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_sensitive(key: str | Column) -> bool | Column:
    """A key that is never kept; longer words that merely contain one are kept."""
    if isinstance(key, str):
        return re.sub("[^a-z0-9]+", "_", key.lower()).strip("_") in SENSITIVE_KEYS
    return normalized_key(key).isin(list(SENSITIVE_KEYS))


# Fixed value: what stands in for an exception, and how one looks once it is text.
REDACTED_EXCEPTION = "[REDACTED_EXCEPTION]"
_EXCEPTION = r"\A\s*(?:Traceback \(most recent call last\):|(?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*(?:Error|Exception)(?:\(|: |\Z))"


def _safe(value: object) -> object:
    if isinstance(value, dict):
        return {key: _safe(item) for key, item in value.items() if not is_sensitive(key)}
    if isinstance(value, list):
        return [_safe(item) for item in value]
    return REDACTED_EXCEPTION if isinstance(value, str) and re.search(_EXCEPTION, value) else value


@F.pandas_udf(T.StringType())
def _safe_documents(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else json.dumps(_safe(json.loads(text)), ensure_ascii=False))


def redacted_json(text: Column) -> Column:
    """Canonical JSON text without sensitive keys at any depth, exceptions replaced; NULL if it is no JSON.

    No schema tells how deep a document is, so this is a batch of Python calls. Numbers stay hidden in strings there.
    """
    hidden = F.to_json(F.try_parse_json(_hidden(text)))
    return _shown(F.to_json(F.parse_json(_safe_documents(hidden))))


def redacted(value: Column, data_type: T.DataType) -> Column:
    """A value without sensitive fields and keys at any depth, exceptions replaced by a fixed text.

    The rewrite of structs, arrays and maps is generated from the schema and stays an expression. A value that is a
    variant, or holds variants, comes back as one variant, rewritten as a document.
    """
    if holds_variant(data_type):
        return F.parse_json(redacted_json(F.to_json(value, {"ignoreNullFields": "false"})))

    def keep(key: str | Column) -> bool | Column:
        return not is_sensitive(key) if isinstance(key, str) else ~is_sensitive(key)

    def scalar(inner: Column, inner_type: T.DataType) -> Column:
        if isinstance(inner_type, T.StringType):
            return F.when(inner.rlike(_EXCEPTION), REDACTED_EXCEPTION).otherwise(inner)
        return inner

    return rewritten(value, data_type, keep=keep, scalar=scalar)[0]


def canonical_row(frame: DataFrame) -> Column:
    """Columns of a row as JSON with sorted keys and explicit NULLs; vendor metadata is left out."""
    fields = [frame.schema[name] for name in sorted(frame.columns) if name != "vendor_metadata"]
    text = F.to_json(F.struct(*[column(field.name) for field in fields]), {"ignoreNullFields": "false"})
    # Keys inside of maps and structs are sorted only where there are any; lists of plain values stay as they are written.
    nested = [field.dataType for field in fields if is_nested(field.dataType)]
    return text if all(_is_plain_list(data_type) for data_type in nested) else F.to_json(F.parse_json(text))


def _is_plain_list(data_type: T.DataType) -> bool:
    """A list of values whose text is the same in a row and in a variant."""
    if not isinstance(data_type, T.ArrayType):
        return False
    return isinstance(data_type.elementType, (T.StringType, T.IntegralType, T.BooleanType)) or _is_plain_list(data_type.elementType)


def richness(frame: DataFrame) -> Column:
    """How many scalars a row holds that are not NULL, those inside of nested columns too."""
    total = F.lit(0)
    for field in frame.schema.fields:
        total = total + leaf_count(column(field.name), field.dataType)
    return total
