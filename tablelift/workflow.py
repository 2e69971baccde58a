"""Whole runs: stage, publish, clean up and validate, with one evidence row per step."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelift.operators.metrics import checks_frame, checks_of
from tablelift.operators.reconcile import reconcile, report, validate
from tablelift.plans.plan import Plan
from tablelift.session import assert_session
from tablelift.plans.limits import Endpoint
from tablelift.sinks.publish import PublishRefused, insert, publish, publish_rules
from tablelift.sinks.staging import drop_staging, transfer

RUN_LOG = "RUN_LOG"
STEP_SCHEMA = (
    "run_id string, step int, stage string, status string, rows bigint, detail string, plan_version int,"
    " plan_fingerprint string"
)


def load(
    source: DataFrame, plan: Plan, target: str, database: str, transport_id: str | uuid.UUID, *,
    ends: tuple[Endpoint, Endpoint] | None = None, report: Callable[[int, int, int], None] | None = None, landing: dict | None = None,
) -> DataFrame:
    """Stage, publish and drop staging. Stops at the first step that fails; the rest stay unrun.

    ``ends``, ``report`` and the ``landing`` options are those of ``transfer``; the reason of a failed step is its detail.

    A run that was published before is not repeated: its evidence is read from the run log of the staging database.
    Staging is dropped after the insert committed or provably wrote nothing; an insert of unknown outcome keeps it.
    """
    spark = source.sparkSession
    assert_session(spark)
    run_id, steps = str(transport_id), []

    def record(stage_name: str, status: str, rows: int | None, detail: str | None) -> None:
        steps.append((run_id, len(steps) + 1, stage_name, status, rows, detail, plan.version, plan.fingerprint()))

    earlier = run_log(spark, database).filter(F.col("run_id") == run_id)
    published = earlier.filter("stage = 'EXECUTING' AND status = 'SUCCEEDED'").select("plan_fingerprint").distinct().collect()
    if published:
        if [row.plan_fingerprint for row in published] == [plan.fingerprint()]:
            return replayed(earlier, run_id, plan)
        record("STAGING", "FAILED", None, "RUN_ID_REUSED")
        return spark.createDataFrame(steps, STEP_SCHEMA)
    _run(source, plan, target, database, transport_id, record, ends, report, landing)
    done = spark.createDataFrame(steps, STEP_SCHEMA)
    insert(spark, done.coalesce(1), f"{database}.{RUN_LOG}")
    return done


def _run(
    source: DataFrame, plan: Plan, target: str, database: str, transport_id: str | uuid.UUID, record: Callable,
    ends: tuple[Endpoint, Endpoint] | None, report: Callable[[int, int, int], None] | None, landing: dict | None,
) -> None:
    spark = source.sparkSession
    # The publish rules are counted by the job that writes the staging table.
    landing = {"rules": lambda frame: publish_rules(frame, plan)} | (landing or {})
    try:
        outcome = transfer(source, transport_id, database, ends=ends, report=report, **landing)
    except Exception as error:
        record("STAGING", "FAILED", None, type(error).__name__)
        return
    if outcome.disposition != "SUCCEEDED":
        record("STAGING", "FAILED", None, outcome.reason)
        return
    staged = outcome.staged
    record("STAGING", "SUCCEEDED", staged.rows_written, staged.relation)
    try:
        record("EXECUTING", "SUCCEEDED", publish(staged.frame(spark), plan, target, broken=staged.broken), target)
    except PublishRefused as error:
        record("EXECUTING", "FAILED", None, type(error).__name__)
    except Exception:
        # Rows may have been written: what was staged is the proof and stays.
        record("EXECUTING", "FAILED", None, "OUTCOME_UNCERTAIN")
        return
    try:
        drop_staging(spark, staged.relation, database)
        record("CLEANING_UP", "SUCCEEDED", None, staged.relation)
    except Exception as error:
        record("CLEANING_UP", "FAILED", None, type(error).__name__)


def run_log(spark: SparkSession, database: str) -> DataFrame:
    """Evidence of all runs over this staging database; the table is made at the first call."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{RUN_LOG} ({STEP_SCHEMA}) USING parquet")
    return spark.table(f"{database}.{RUN_LOG}")


def replayed(log: DataFrame, run_id: str, plan: Plan) -> DataFrame:
    """Evidence of an earlier identical run; empty when the run has to be done."""
    return log.filter((F.col("run_id") == run_id) & (F.col("plan_fingerprint") == plan.fingerprint()))


def full_run(
    spark: SparkSession, source: DataFrame, plan: Plan, target: str, database: str, transport_id: str | uuid.UUID
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, checks, report) of one migration. Validation reads the live source and the target table.

    Only a published run is validated. After a failed step every check is UNAVAILABLE and the report FAILED.
    """
    steps = load(source, plan, target, database, transport_id)
    failed = steps.filter("status = 'FAILED' AND stage <> 'CLEANING_UP'").count() > 0
    if not failed:
        checks = validate(source, spark.table(target), plan)
        return steps, checks, report(checks, plan_version=plan.version)
    nothing = spark.createDataFrame([], "check_id string, value bigint")
    checks = reconcile(checks_frame(spark, checks_of(plan)), nothing, nothing)
    return steps, checks, report(checks, plan_version=plan.version).withColumn("status", F.lit("FAILED"))
