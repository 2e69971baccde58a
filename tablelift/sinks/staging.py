"""Staging: land a source losslessly in a new table, prove the row count, drop it again."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.functions.json import canonical_json, json_issue, json_text
from tablelift.functions.types import UnsupportedTypeError, family_of, landing_type
from tablelift.plans.expressions import column, quote
from tablelift.plans.limits import Endpoint, preflight
from tablelift.session import shared_dir

PREFIX = "STAGE_"
_NAME = re.compile(r"STAGE_[0-9A-F]{32}")
EVIDENCE_SCHEMA = (
    "transport_id string, relation string, rows_read bigint, rows_written bigint, rows_rejected bigint, files bigint, status string"
)


class TransferError(RuntimeError):
    """A load that did not end well. ``category`` says whether anything is left behind, ``reason`` where it failed."""

    def __init__(self, message: str, category: str, reason: str = "STAGING_LOAD_FAILED") -> None:
        super().__init__(message)
        self.category = category
        self.reason = reason


@dataclass(frozen=True)
class Staged:
    """A staged table and the evidence of its load. ``broken`` counts rows per rule that was asked for."""

    transport_id: str
    relation: str
    rows_read: int
    rows_written: int
    files: int
    rows_rejected: int = 0
    rejected: str | None = None
    broken: dict[str, int] | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.relation)

    def evidence(self, spark: SparkSession) -> DataFrame:
        row = (self.transport_id, self.relation, self.rows_read, self.rows_written, self.rows_rejected, self.files, "STAGED")
        return spark.createDataFrame([row], EVIDENCE_SCHEMA)


def staging_name(transport_id: str | uuid.UUID) -> str:
    """Deterministic per attempt: a retry of one attempt addresses the same table."""
    return PREFIX + uuid.UUID(str(transport_id)).hex.upper()


def staging_database(spark: SparkSession, name: str = "tablelift_staging") -> str:
    """Database whose managed tables live in the shared work folder."""
    location = f"{shared_dir(spark)}/{name}".replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(name)} LOCATION '{location}'")
    return name


def staging_schema(schema: T.StructType) -> T.StructType:
    """Landing types of a source schema, or an error before any job starts."""
    names = [field.name for field in schema.fields]
    if len(set(names)) != len(names):
        raise ValueError("Staging needs unique column names.")
    fields = []
    for field in schema.fields:
        family = family_of(field.dataType)
        precision = field.dataType.precision if isinstance(field.dataType, T.DecimalType) else None
        scale = field.dataType.scale if isinstance(field.dataType, T.DecimalType) else None
        try:
            landed = landing_type(family, spark_type=field.dataType, precision=precision, scale=scale)
        except UnsupportedTypeError as error:
            raise UnsupportedTypeError(f"Column {field.name!r}: {error}") from None
        if isinstance(field.dataType, T.DecimalType):
            landed = field.dataType
        fields.append(T.StructField(field.name, landed, field.nullable))
    return T.StructType(fields)


def _is_document(name: str, data_type: T.DataType, json_columns: Sequence[str]) -> bool:
    return name in json_columns or family_of(data_type) == "SEMI_STRUCTURED"


def landed_value(name: str, source: T.DataType, landed: T.DataType, json_columns: Sequence[str] = ()) -> Column:
    """NULL stays NULL, documents become canonical JSON with every digit, the rest is cast."""
    value = column(name)
    if _is_document(name, source, json_columns):
        return canonical_json(value, source)
    return value if source == landed else value.cast(landed)


def landed(source: DataFrame, json_columns: Sequence[str] = ()) -> DataFrame:
    """The source in its staging types. ``json_columns`` are text columns that hold JSON."""
    return source.select(*_landed_columns(source, json_columns))


def _landed_columns(source: DataFrame, json_columns: Sequence[str], rendered: dict[str, str] | None = None) -> list[Column]:
    """Columns in their staging types; ``rendered`` names the columns that hold a document's canonical JSON already."""
    fields = zip(source.schema.fields, staging_schema(source.schema).fields, strict=True)
    known = rendered or {}
    return [
        (column(known[old.name]) if old.name in known else landed_value(old.name, old.dataType, new.dataType, json_columns)).alias(new.name)
        for old, new in fields
    ]


def _rendered(source: DataFrame, json_columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """The source with the canonical JSON of each document beside it, made once however many steps look at it."""
    documents = [field for field in source.schema.fields if _is_document(field.name, field.dataType, json_columns)]
    names = {field.name: f"__canonical_{place}" for place, field in enumerate(documents)}
    added = [canonical_json(column(field.name), field.dataType).alias(names[field.name]) for field in documents]
    return source.select(*[column(name) for name in source.columns], *added), names


def landing_issues(source: DataFrame, json_columns: Sequence[str] = (), rendered: dict[str, str] | None = None) -> Column | None:
    """Values of a row that have no canonical form: column, code and raw text; None if no column can have one."""
    items = []
    for field in source.schema.fields:
        if _is_document(field.name, field.dataType, json_columns):
            canonical = column(rendered[field.name]) if rendered else None
            code, text = json_issue(column(field.name), field.dataType, canonical), json_text(column(field.name), field.dataType)
            found = F.struct(F.lit(field.name).alias("column_name"), code.alias("code"), text.alias("raw_text"))
            items.append(F.when(code.isNotNull(), found))
    return F.array_compact(F.array(*items)) if items else None


def stage(
    source: DataFrame,
    transport_id: str | uuid.UUID,
    database: str,
    *,
    required: Sequence[str] = (),
    json_columns: Sequence[str] = (),
    quarantine: bool = False,
    rules: Callable[[DataFrame], dict[str, Column]] | None = None,
) -> Staged:
    """Write the source to a new staging table and prove that every row arrived.

    One narrow write job. The observed counts sit in the writing stage, whose tasks
    count once however often they are retried; the stored count comes from reading
    the files back without any column. A difference, like any failure, drops the table.

    ``required`` columns must not hold NULL; stored files do not enforce it, so the writing job counts. Rows with a document
    that has no canonical form are refused, or with ``quarantine`` left out and written with their reason to a table of
    their own; only then the source is read again. ``rules`` name conditions on the landed frame whose hits are counted along.
    """
    spark = source.sparkSession
    relation = f"{quote(database)}.{quote(staging_name(transport_id))}"
    if spark.catalog.tableExists(f"{database}.{staging_name(transport_id)}"):
        raise TransferError("The staging table exists already.", "STAGING_EXISTS", "STAGING_EXISTS")
    wide, rendered = _rendered(source, json_columns)
    observed, issues = Observation(), landing_issues(source, json_columns, rendered)
    rejected = F.lit(False) if issues is None else F.size("__issues") > 0
    frame = landed(source, json_columns) if issues is None else wide.select(*_landed_columns(source, json_columns, rendered), issues.alias("__issues"))
    counted = {f"null:{name}": ~rejected & column(name).isNull() for name in required}
    counted |= {f"rule:{name}": ~rejected & rule for name, rule in (rules(frame.drop("__issues")) if rules else {}).items()}
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(rejected).alias("rejected"), *[F.count_if(hit).alias(name) for name, hit in counted.items()]]
    kept = frame.observe(observed, *metrics)
    if issues is not None:
        kept = kept.filter(~rejected).drop("__issues")
    try:
        kept.write.mode("errorifexists").format("parquet").saveAsTable(relation)
        written, files = _stored(spark.table(relation))
        counts = observed.get
        if counts["rows"] != written + counts["rejected"]:
            raise TransferError(f"Read {counts['rows']} rows but stored {written}.", "STAGING_LOAD_FAILED")
        missing = {name[5:]: counts[name] for name in counted if name.startswith("null:") and counts[name]}
        if missing:
            raise TransferError(f"Required columns hold NULL: {missing}", "STAGING_LOAD_FAILED", "NULL_IN_REQUIRED_COLUMN")
        if counts["rejected"] and not quarantine:
            raise TransferError(f"{counts['rejected']} rows hold unreadable values.", "STAGING_LOAD_FAILED", "UNREADABLE_VALUES")
        aside = _set_aside(source, transport_id, database, json_columns) if counts["rejected"] else None
    except Exception as error:
        raise _cleaned_up(spark, relation, database, error) from error
    broken = {name[5:]: counts[name] for name in counted if name.startswith("rule:")}
    return Staged(str(transport_id), relation, counts["rows"], written, files, counts["rejected"], aside, broken if rules else None)


def _set_aside(source: DataFrame, transport_id: str | uuid.UUID, database: str, json_columns: Sequence[str]) -> str:
    """Write what was rejected, one evidence row per unreadable value, and return the table."""
    relation = f"{quote(database)}.{quote('REJECTED_' + uuid.UUID(str(transport_id)).hex.upper())}"
    wide, rendered = _rendered(source, json_columns)
    evidence = wide.select(F.explode(landing_issues(source, json_columns, rendered)).alias("issue")).select("issue.*")
    evidence.write.mode("overwrite").format("parquet").saveAsTable(relation)
    return relation


@dataclass(frozen=True)
class Outcome:
    """How a transfer ended: its disposition, where it failed, and what was staged."""

    disposition: str
    reason: str | None = None
    staged: Staged | None = None


def transfer(
    source: DataFrame,
    transport_id: str | uuid.UUID,
    database: str,
    *,
    ends: tuple[Endpoint, Endpoint] | None = None,
    report: Callable[[int, int, int], None] | None = None,
    **landing: object,
) -> Outcome:
    """``stage`` as steps whose failures are told apart: preflight, load, progress report.

    A transfer that its ``ends`` do not permit touches nothing. After a failed load or ``report`` (of files, rows read and rows written)
    the staging table is dropped, which makes another try safe; if that fails too, the outcome is uncertain.
    """
    if ends is not None:
        try:
            preflight(*ends, database, None, None)
        except (PermissionError, ValueError):
            return Outcome("REFUSED", "TRANSPORT_NOT_PERMITTED")
    try:
        staged = stage(source, transport_id, database, **landing)
    except TransferError as error:
        uncertain = error.category == "OUTCOME_UNCERTAIN"
        return Outcome(error.category, "STAGING_OUTCOME_UNCERTAIN" if uncertain else error.reason)
    try:
        if report is not None:
            report(staged.files, staged.rows_read, staged.rows_written)
    except Exception as error:
        failed = _cleaned_up(source.sparkSession, staged.relation, database, error)
        uncertain = failed.category == "OUTCOME_UNCERTAIN"
        return Outcome(failed.category, "STAGING_OUTCOME_UNCERTAIN" if uncertain else "PROGRESS_REPORTING_FAILED")
    return Outcome("SUCCEEDED", None, staged)


def _stored(frame: DataFrame) -> tuple[int, int]:
    """(rows, files) as stored, from a scan that reads no column."""
    row = file_evidence(frame).agg(F.sum("rows_written").alias("rows"), F.count(F.lit(1)).alias("files")).first()
    return row.rows or 0, row.files


def _cleaned_up(spark: SparkSession, relation: str, database: str, error: Exception) -> TransferError:
    try:
        drop_staging(spark, relation, database)
    except Exception:
        return TransferError(f"{error} Staging may be left behind.", "OUTCOME_UNCERTAIN", "STAGING_OUTCOME_UNCERTAIN")
    return TransferError(str(error), "CONFIRMED_FAILED_CLEANED_UP", getattr(error, "reason", "STAGING_LOAD_FAILED"))


def drop_staging(spark: SparkSession, relation: str, database: str) -> None:
    """Drop a staging table of the configured database; nothing else can be dropped here."""
    parts = [part.strip("`") for part in relation.split(".")]
    if len(parts) != 2 or parts[0] != database or _NAME.fullmatch(parts[1]) is None:
        raise ValueError("Not a staging table of this database.")
    spark.sql(f"DROP TABLE IF EXISTS {quote(parts[0])}.{quote(parts[1])}")


def file_evidence(stored: DataFrame) -> DataFrame:
    """Rows per written file: the batches of a parallel load."""
    return stored.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows_written"))


def totals(read: DataFrame, files: DataFrame) -> DataFrame:
    """Rows read against rows written, from a counted source and per-file evidence."""
    sides = read.agg(F.count(F.lit(1)).alias("rows_read"), F.lit(0).cast("bigint").alias("rows_written")).unionByName(
        files.agg(F.lit(0).cast("bigint").alias("rows_read"), F.coalesce(F.sum("rows_written"), F.lit(0)).alias("rows_written"))
    )
    summed = sides.agg(F.sum("rows_read").alias("rows_read"), F.sum("rows_written").alias("rows_written"))
    return summed.withColumn("complete", F.col("rows_read") == F.col("rows_written"))
