"""Bulk checks over evidence logs: audit events, artifacts, idempotency keys, jobs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelift.functions.json import fingerprint
from tablelift.operators.ordered import running
from tablelift.plans.limits import page_bounds

# The legal status changes of a workflow; states without successors are terminal.
WORKFLOW_TRANSITIONS = {
    "DRAFT": ["DISCOVERED", "FAILED", "CANCELLED"],
    "DISCOVERED": ["MAPPING_PROPOSED", "FAILED", "CANCELLED"],
    "MAPPING_PROPOSED": ["MAPPING_APPROVED", "FAILED", "CANCELLED"],
    "MAPPING_APPROVED": ["STAGING", "EXECUTION_READY", "FAILED", "CANCELLED"],
    "STAGING": ["STAGED", "MAPPING_APPROVED", "STAGING_RECOVERY_REQUIRED"],
    "STAGED": ["EXECUTION_READY", "FAILED", "CANCELLED"],
    "STAGING_RECOVERY_REQUIRED": ["FAILED", "CANCELLED"],
    "EXECUTION_READY": ["EXECUTING", "FAILED", "CANCELLED"],
    "EXECUTING": ["EXECUTED", "EXECUTION_READY", "EXECUTION_RECOVERY_REQUIRED"],
    "EXECUTED": ["VALIDATION_READY", "VALIDATING", "FAILED", "CANCELLED"],
    "EXECUTION_RECOVERY_REQUIRED": ["FAILED", "CANCELLED"],
    "VALIDATION_READY": ["VALIDATING", "FAILED", "CANCELLED"],
    "VALIDATING": [
        "VALIDATED", "VALIDATION_REVIEW_REQUIRED", "VALIDATION_RECOVERY_REQUIRED", "FAILED", "CANCELLED",
    ],
    "VALIDATED": [],
    "VALIDATION_REVIEW_REQUIRED": [],
    "VALIDATION_RECOVERY_REQUIRED": ["FAILED", "CANCELLED"],
    "FAILED": [],
    "CANCELLED": [],
}

# The stages of a job, each followed by the next.
JOB_STAGES = (
    "QUEUED", "PREPARING", "STAGING", "TRANSFORMING", "EXECUTING", "CLEANING_UP", "VALIDATING", "COMPLETED",
)
JOB_TRANSITIONS = {stage: list(JOB_STAGES[at + 1 : at + 2]) for at, stage in enumerate(JOB_STAGES)}


def with_sequence(events: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Number the events of every workflow from 1."""
    return running(events, [key], order, bucket, totals={"sequence_number": F.lit(1).cast("bigint")})


def sealed(artifacts: DataFrame) -> DataFrame:
    """Artifacts with the SHA-256 of their payload."""
    return artifacts.withColumn("payload_sha256", fingerprint(F.col("payload")))


def append(artifacts: DataFrame, log: str) -> None:
    """Add sealed artifacts to a log; existing rows are never rewritten."""
    sealed(artifacts).write.mode("append").parquet(log)


def hash_mismatches(artifacts: DataFrame) -> DataFrame:
    """Artifacts whose payload no longer has its recorded SHA-256."""
    return artifacts.filter(~fingerprint(F.col("payload")).eqNullSafe(F.col("payload_sha256")))


def latest_per_type(artifacts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest artifact per workflow and type. Folds on the map side; no ranking window."""
    others = [name for name in artifacts.columns if name not in keys]
    newest = artifacts.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("newest"))
    return newest.select(*keys, "newest.*")


def stale_references(references: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References to an artifact version that is not (or no longer) the newest of its type."""
    keys = ["workflow_id", "artifact_type"]
    newest = artifacts.groupBy(*keys).agg(F.max("artifact_version").alias("latest_version"))
    joined = references.join(newest, keys, "left")
    return joined.filter(~F.col("artifact_version").eqNullSafe(F.col("latest_version")))


def idempotency(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: how often it came, and whether two different requests used it."""
    per_key = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.min("request_sha256").alias("low"),
        F.max("request_sha256").alias("high"),
    )
    same = F.col("low") == F.col("high")
    return per_key.select(
        *keys,
        "requests",
        F.when(~same, "CONFLICT").when(F.col("requests") > 1, "REPLAY").otherwise("FIRST").alias("outcome"),
    )


def is_allowed(previous: Column, new: Column, transitions: dict[str, list[str]]) -> Column:
    """The change is in the transition graph, a constant of a few dozen pairs."""
    pairs = [f"{old}>{follower}" for old, followers in transitions.items() for follower in followers]
    return F.concat_ws(">", previous, new).isin(pairs)


def transition_violations(
    events: DataFrame, key: str, status: str, order: list[str], bucket: Column, transitions: dict[str, list[str]]
) -> DataFrame:
    """Consecutive statuses of one workflow that the graph does not allow."""
    chained = running(events, [key], order, bucket, previous={"previous_status": status})
    old = F.col("previous_status")
    return chained.filter(old.isNotNull() & ~is_allowed(old, F.col(status), transitions))


def chain_breaks(events: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Events whose recorded previous status is not the new status of the event before."""
    chained = running(events, [key], order, bucket, previous={"actual_previous": "new_status"})
    actual = F.col("actual_previous")
    return chained.filter(actual.isNotNull() & ~F.col("previous_status").eqNullSafe(actual))


def sequence_gaps(events: DataFrame, key: str) -> DataFrame:
    """Workflows whose sequence numbers are not exactly 1..n."""
    number = F.col("sequence_number")
    counts = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.min(number).alias("first_number"),
        F.max(number).alias("last_number"),
    )
    return counts.filter((F.col("first_number") != 1) | (F.col("last_number") != F.col("events")))


def version_breaks(events: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Versions must stay (paired events) or grow by one."""
    chained = running(events, [key], order, bucket, previous={"previous_version": "workflow_version"})
    step = F.col("workflow_version") - F.col("previous_version")
    return chained.filter(F.col("previous_version").isNotNull() & ~step.isin(0, 1))


def event_shape(event_type: Column, previous: Column, new: Column, has_artifact: Column) -> Column:
    """Whether an event's fields fit its type."""
    changed = ~has_artifact & previous.isNotNull() & new.isNotNull()
    return (
        F.when(event_type == "WORKFLOW_CREATED", previous.isNull() & new.eqNullSafe(F.lit("DRAFT")) & ~has_artifact)
        .when(event_type == "ARTIFACT_APPENDED", has_artifact & new.isNotNull() & previous.eqNullSafe(new))
        .when(event_type == "STATUS_CHANGED", changed & ~new.isin("FAILED", "CANCELLED"))
        .when(event_type == "WORKFLOW_FAILED", changed & (new == "FAILED"))
        .when(event_type == "WORKFLOW_CANCELLED", changed & (new == "CANCELLED"))
        .otherwise(False)
    )


def several_active(jobs: DataFrame, key: str, is_active: Column) -> DataFrame:
    """Workflows with more than one active job."""
    counts = jobs.groupBy(key).agg(F.count_if(is_active).alias("active"))
    return counts.filter(F.col("active") > 1)


def duration_ms(start: Column, end: Column) -> Column:
    """Elapsed milliseconds, never negative."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.greatest(F.lit(0).cast("bigint"), F.floor(micros / 1000).cast("bigint"))


# Stages in which a job can report progress of its batches.
PROGRESS_STAGES = ("STAGING", "TRANSFORMING", "EXECUTING", "CLEANING_UP", "VALIDATING", "COMPLETED")


def batch_progress_violations(jobs: DataFrame, batches: DataFrame) -> DataFrame:
    """Batch reports that do not fit their job: outside of its time, in a stage without batches, or inconsistent.

    ``batches`` holds job_id, stage, batches_completed, rows_read, rows_written, total_rows_estimate and progress_updated_at. Each
    report is measured against the one row of its job; the running job's time has no end. Only reports that break a rule are returned.
    """
    spans = jobs.select("job_id", "started_at", "completed_at", F.lit(True).alias("known"))
    joined = batches.join(spans, "job_id", "left")
    at, done = F.col("progress_updated_at"), F.col("batches_completed")
    counts = [F.col(name) for name in ("batches_completed", "rows_read", "rows_written", "total_rows_estimate")]
    rules = [
        ("UNKNOWN_JOB", F.col("known").isNull()),
        ("MISSING_TIME", at.isNull()),
        ("NOT_STARTED", F.col("known") & F.col("started_at").isNull()),
        ("BEFORE_START", at < F.col("started_at")),
        ("AFTER_END", at > F.col("completed_at")),
        ("ILLEGAL_STAGE", ~F.col("stage").isin(*PROGRESS_STAGES)),
        ("NEGATIVE_COUNT", F.least(*counts) < 0),
        ("COUNTS_DIFFER", F.col("rows_read") != F.col("rows_written")),
        ("BATCHES_WITHOUT_ROWS", (done == 0) != (F.col("rows_read") == 0)),
    ]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules]))
    return joined.select(*batches.columns, codes.alias("violations")).filter(F.size("violations") > 0)


def stage_gaps(jobs: DataFrame, batches: DataFrame, key: str = "job_id") -> DataFrame:
    """Per job and stage the time its batches cover, and whether it lies inside the job's time as a whole.

    Intervals are contained if their ends are, so one row per job and stage is compared, however many reports there are.
    """
    covered = batches.groupBy(key, "stage").agg(
        F.count(F.lit(1)).alias("reports"), F.min("progress_updated_at").alias("first_at"), F.max("progress_updated_at").alias("last_at")
    )
    spans = jobs.select(key, "started_at", "completed_at")
    inside = (F.col("first_at") >= F.col("started_at")) & F.coalesce(F.col("last_at") <= F.col("completed_at"), F.lit(True))
    return covered.join(spans, key).select(key, "stage", "reports", "first_at", "last_at", F.coalesce(inside, F.lit(False)).alias("is_contained"))


def job_violations(jobs: DataFrame) -> DataFrame:
    """Codes of the lifecycle rules each job breaks; an empty array means consistent."""
    status, stage = F.col("status"), F.col("stage")
    started, completed, failure = F.col("started_at"), F.col("completed_at"), F.col("failure_category")
    duration = F.col("duration_ms")
    working = ~stage.isin("QUEUED", "COMPLETED")
    done = started.isNotNull() & completed.isNotNull() & duration.isNotNull()
    lifecycle = (
        F.when(
            status == "QUEUED",
            (stage == "QUEUED") & started.isNull() & completed.isNull() & duration.isNull() & failure.isNull(),
        )
        .when(
            status == "RUNNING",
            working & started.isNotNull() & completed.isNull() & duration.isNull() & failure.isNull(),
        )
        .when(status == "SUCCEEDED", (stage == "COMPLETED") & done & failure.isNull())
        .otherwise(working & done & failure.isNotNull())
    )
    rules = [
        ("STARTED_BEFORE_QUEUED", started < F.col("queued_at")),
        ("COMPLETED_BEFORE_STARTED", completed.isNotNull() & (started.isNull() | (completed < started))),
        ("NEGATIVE_DURATION", duration < 0),
        ("INVALID_FAILURE_CATEGORY", ~failure.rlike(r"\A[A-Z][A-Z0-9_]{0,63}\z")),
        ("LIFECYCLE_INCONSISTENT", ~lifecycle),
    ]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules]))
    return jobs.withColumn("violations", codes)


PROGRESS_COLUMNS = ("batches_completed", "rows_read", "rows_written", "total_rows_estimate", "updated_at")


def snapshot_violations(previous: dict[str, Column], current: dict[str, Column], has_previous: Column) -> Column:
    """Codes of the rules a progress snapshot breaks, alone and after the one before."""
    consistent = (current["rows_read"] == current["rows_written"]) & (
        (current["batches_completed"] == 0) == (current["rows_read"] == 0)
    )
    rules = [
        ("INCONSISTENT_COUNTS", ~consistent),
        ("BATCHES_NOT_GROWING", has_previous & (current["batches_completed"] <= previous["batches_completed"])),
        (
            "ROWS_NOT_GROWING",
            has_previous
            & ((current["rows_read"] <= previous["rows_read"]) | (current["rows_written"] <= previous["rows_written"])),
        ),
        ("TIME_NOT_GROWING", has_previous & (current["updated_at"] <= previous["updated_at"])),
        (
            "ESTIMATE_CHANGED",
            has_previous & ~current["total_rows_estimate"].eqNullSafe(previous["total_rows_estimate"]),
        ),
    ]
    return F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules]))


def progress_violations(snapshots: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Snapshots that break a rule, in the order of the log."""
    # The order column itself is always there, so it tells whether there was a row before.
    names = {f"previous_{name}": name for name in PROGRESS_COLUMNS} | {"__seen": order[0]}
    chained = running(snapshots, [key], order, bucket, previous=names)
    previous = {name: F.col(f"previous_{name}") for name in PROGRESS_COLUMNS}
    current = {name: F.col(name) for name in PROGRESS_COLUMNS}
    codes = snapshot_violations(previous, current, F.col("__seen").isNotNull())
    flagged = chained.withColumn("violations", codes).filter(F.size("violations") > 0)
    return flagged.select(*snapshots.columns, "violations")


def percent_complete(rows_read: Column, estimate: Column) -> Column:
    """0 to 100, NULL without an estimate, 100 when the estimate is zero."""
    # Decimal arithmetic: a double loses the last digits of large counts.
    exact = rows_read.cast("decimal(20,0)") * 100 / F.nullif(estimate, F.lit(0)).cast("decimal(20,0)")
    percent = F.floor(exact).cast("bigint")
    return F.when(estimate == 0, F.lit(100).cast("bigint")).when(
        estimate.isNotNull(), F.least(F.lit(100).cast("bigint"), percent)
    )


LINEAGE_KINDS = ("LOAD", "EXECUTION", "CLEANUP", "VALIDATION")


def lineage(evidence: DataFrame, key: str) -> DataFrame:
    """Whether the evidence of a run names one plan version, relation and fingerprint throughout.

    One aggregation instead of a join per kind: the smallest and the largest value
    agree exactly when all do. A NULL next to a value is a difference.
    """
    facts = ("plan_version", "relation", "plan_fingerprint")

    def same(name: str) -> Column:
        present = F.count(name)
        return F.min(name).eqNullSafe(F.max(name)) & ((present == 0) | (present == F.count(F.lit(1))))

    # Only the four known kinds are collected, however many rows a run has.
    known = F.when(F.col("kind").isin(*LINEAGE_KINDS), F.col("kind"))
    per_run = evidence.groupBy(key).agg(
        F.collect_set(known).alias("kinds"), *[same(name).alias(f"same_{name}") for name in facts]
    )
    missing = F.array_except(F.array(*[F.lit(kind) for kind in LINEAGE_KINDS]), F.col("kinds"))
    consistent = F.col("same_plan_version") & F.col("same_relation") & F.col("same_plan_fingerprint")
    return per_run.select(
        key,
        F.array_join(missing, ",").alias("missing"),
        *[f"same_{name}" for name in facts],
        (consistent & (F.size(missing) == 0)).alias("proven"),
    )


def oldest_queued(jobs: DataFrame) -> DataFrame:
    """The job that has waited longest: a top-1, not a full sort."""
    return jobs.filter(F.col("status") == "QUEUED").orderBy("queued_at", "job_id").limit(1)


def page(frame: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of 1 to 500 rows."""
    limit, offset = page_bounds(limit, offset)
    return frame.orderBy(*order).offset(offset).limit(limit)
