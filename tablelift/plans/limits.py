"""Request limits: a caller may lower a profile's limit, never raise it."""

from __future__ import annotations

from dataclasses import dataclass

# Profile defaults and hard caps.
DEFAULT_ROWS = 500
MAX_ROWS = 10_000
DEFAULT_TIMEOUT_SECONDS = 30
MAX_PAGE = 500


def effective_limit(requested: int | None, profile: int) -> int:
    """min(requested, profile); both must be positive integers."""
    for value in (profile, profile if requested is None else requested):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError("Limits must be positive integers.")
    return profile if requested is None else min(requested, profile)


def page_bounds(limit: int, offset: int) -> tuple[int, int]:
    if isinstance(limit, bool) or not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"Pages hold 1 to {MAX_PAGE} rows and start at 0 or later.")
    return limit, offset


@dataclass(frozen=True)
class Endpoint:
    """What a reader or writer allows."""

    database: str
    can_read: bool = True
    can_write: bool = False
    max_rows: int = MAX_ROWS
    timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS


def preflight(source: Endpoint, target: Endpoint, database: str, rows: int | None, timeout: int | None) -> tuple[int, int]:
    """(fetch size, timeout) for a transfer, or an error before anything is touched."""
    if not source.can_read:
        raise PermissionError("The source cannot be read.")
    if not target.can_write:
        raise PermissionError("The target is not write-enabled.")
    if target.database != database:
        raise ValueError("The target database is not the configured one.")
    return (
        effective_limit(rows, min(source.max_rows, target.max_rows)),
        effective_limit(timeout, min(source.timeout_seconds, target.timeout_seconds)),
    )
