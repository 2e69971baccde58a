"""Approved mapping plans and the checks every consumer of a plan relies on."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import types as T

from tablelift.plans.expressions import Expr, InvalidPlanError, columns_read, to_dict

APPROVED_STATUSES = ("APPROVED", "OVERRIDDEN")
STATUSES = ("PENDING", "APPROVED", "REJECTED", "OVERRIDDEN")


@dataclass(frozen=True)
class Approval:
    """The reviewed disposition of one source column."""

    source_column: str
    status: str = "PENDING"
    target_column: str | None = None
    target_type: T.DataType | None = None
    target_ordinal: int | None = None
    target_nullable: bool = True
    compatibility: str = "UNKNOWN"
    transformation: Expr | None = None
    override_reason: str | None = None

    def __post_init__(self) -> None:
        if self.status not in STATUSES:
            raise InvalidPlanError(f"Unknown status {self.status!r}.")
        if self.status == "REJECTED" and (self.target_column is not None or self.transformation is not None):
            raise InvalidPlanError("Rejected columns carry no target and no transformation.")
        if self.status in APPROVED_STATUSES and self.target_column is None:
            raise InvalidPlanError("Approved columns need a target.")
        if self.status == "APPROVED" and self.compatibility == "INCOMPATIBLE":
            raise InvalidPlanError("Incompatible columns need OVERRIDDEN.")
        if self.status == "OVERRIDDEN" and not (self.override_reason or "").strip():
            raise InvalidPlanError("OVERRIDDEN needs a reason.")


@dataclass(frozen=True)
class Plan:
    """One reviewed table pair; ``approvals`` holds every source column exactly once."""

    source_table: str
    target_table: str
    approvals: tuple[Approval, ...]
    version: int = 1

    def __post_init__(self) -> None:
        if self.version < 1:
            raise InvalidPlanError("Plan versions start at 1.")
        sources = [item.source_column for item in self.approvals]
        if len(set(sources)) != len(sources):
            raise InvalidPlanError("Each source column may appear once.")
        targets = [item.target_column for item in self.approvals if item.status in APPROVED_STATUSES]
        if len(set(targets)) != len(targets):
            raise InvalidPlanError("Each target column may be used once.")

    @property
    def source_columns(self) -> tuple[str, ...]:
        return tuple(item.source_column for item in self.approvals)

    @property
    def mappings(self) -> tuple[Approval, ...]:
        """Approved and overridden columns, by target ordinal (unknown last), then name."""
        approved = [item for item in self.approvals if item.status in APPROVED_STATUSES]
        if not approved or any(item.transformation is None for item in approved):
            raise InvalidPlanError("A plan needs at least one approved column, each with a transformation.")
        return tuple(
            sorted(
                approved,
                key=lambda item: (
                    item.target_ordinal is None,
                    0 if item.target_ordinal is None else item.target_ordinal,
                    item.target_column,
                ),
            )
        )

    @property
    def is_complete(self) -> bool:
        """Nothing pending and at least one approved column."""
        return all(item.status != "PENDING" for item in self.approvals) and any(
            item.status in APPROVED_STATUSES for item in self.approvals
        )

    def lineage(self, *, nested: bool = False) -> tuple[str, ...]:
        """Source columns read by the projection, in first-use order."""
        names: list[str] = []
        for item in self.mappings:
            names.extend(columns_read(item.transformation, nested=nested))
        return tuple(dict.fromkeys(names))

    def fingerprint(self) -> str:
        """SHA-256 of the canonical JSON of everything that shapes the output."""
        body = {
            "source": self.source_table,
            "target": self.target_table,
            "version": self.version,
            "mappings": [
                {
                    "source": item.source_column,
                    "target": item.target_column,
                    "type": None if item.target_type is None else item.target_type.simpleString(),
                    "transformation": to_dict(item.transformation),
                }
                for item in self.mappings
            ],
        }
        text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(text.encode()).hexdigest()
