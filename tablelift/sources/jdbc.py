"""JDBC scans of PostgreSQL, MySQL and Snowflake tables through Spark's own reader.

The driver jar of the database has to be on the class path of the session.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablelift.plans.limits import DEFAULT_ROWS, effective_limit
from tablelift.sources.tables import capped, scan

# Identifier quote of each dialect.
_QUOTES = {"postgresql": '"', "mysql": "`", "snowflake": '"', "sqlserver": '"'}


@dataclass(frozen=True)
class Relation:
    """A table; MySQL has one level where the others have two, so catalog and schema must agree."""

    dialect: str
    schema: str
    name: str
    catalog: str | None = None

    def __post_init__(self) -> None:
        if self.dialect not in _QUOTES:
            raise ValueError(f"Unknown dialect {self.dialect!r}.")
        if self.dialect == "mysql" and self.catalog not in (None, self.schema):
            raise ValueError("A MySQL schema is its database.")
        for part in (self.schema, self.name):
            if not part.strip() or "\x00" in part:
                raise ValueError("Relation names must be non-blank text without NUL.")
            if self.dialect == "mysql" and len(part) > 64:
                raise ValueError("MySQL identifiers hold at most 64 characters.")

    def quoted(self) -> str:
        mark = _QUOTES[self.dialect]
        parts = [self.schema, self.name]
        if self.dialect == "snowflake" and self.catalog is not None:
            parts.insert(0, self.catalog)
        return ".".join(mark + part.replace(mark, mark * 2) + mark for part in parts)


@dataclass(frozen=True)
class Split:
    """Parallel reads: ranges of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    partitions: int


def scan_options(
    url: str, relation: Relation, *, fetch_size: int | None, timeout_seconds: int | None, split: Split | None
) -> dict[str, str]:
    """Options of a bounded scan. Without a split one task reads the whole table."""
    options = {
        "url": url,
        "dbtable": relation.quoted(),
        "fetchsize": str(effective_limit(None, DEFAULT_ROWS if fetch_size is None else fetch_size)),
    }
    # A large table takes its time: only a caller who wants an end to it names one.
    if timeout_seconds is not None:
        options["queryTimeout"] = str(timeout_seconds)
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.partitions),
        }
    return options


def read_table(
    spark: SparkSession,
    url: str,
    relation: Relation,
    columns: Sequence[str],
    *,
    fetch_size: int | None = None,
    timeout_seconds: int | None = None,
    split: Split | None = None,
    credentials: dict[str, str] | None = None,
) -> DataFrame:
    """Explicit projection of a remote table; projection and filters are pushed to the database."""
    options = scan_options(url, relation, fetch_size=fetch_size, timeout_seconds=timeout_seconds, split=split)
    return scan(spark.read.format("jdbc").options(**options, **(credentials or {})).load(), columns)


def read_query(
    spark: SparkSession, url: str, sql: str, *, max_rows: int | None = None, timeout_seconds: int | None = None,
    credentials: dict[str, str] | None = None,
) -> DataFrame:
    """A remote SELECT, capped like a local one; whole and without a timeout unless the caller names them."""
    options = {"url": url, "query": sql}
    if timeout_seconds is not None:
        options["queryTimeout"] = str(timeout_seconds)
    return capped(spark.read.format("jdbc").options(**options, **(credentials or {})).load(), max_rows)


def write_table(
    frame: DataFrame, url: str, relation: Relation, *, batch_size: int = DEFAULT_ROWS,
    credentials: dict[str, str] | None = None,
) -> None:
    """Append to a remote staging table. Partitions commit one by one, so publish from staging only."""
    frame.write.format("jdbc").mode("append").options(
        url=url,
        dbtable=relation.quoted(),
        batchsize=str(effective_limit(None, batch_size)),
        **(credentials or {}),
    ).save()
