"""Evidence-log queries: events and conversations read as audit and progress logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelift.functions.json import request_hash
from tablelift.operators.evidence import (
    JOB_TRANSITIONS,
    PROGRESS_STAGES,
    WORKFLOW_TRANSITIONS,
    batch_progress_violations,
    chain_breaks,
    duration_ms,
    event_shape,
    hash_mismatches,
    idempotency,
    is_allowed,
    job_violations,
    latest_per_type,
    lineage,
    oldest_queued,
    page,
    percent_complete,
    progress_violations,
    sealed,
    sequence_gaps,
    several_active,
    stage_gaps,
    stale_references,
    transition_violations,
    version_breaks,
    with_sequence,
)
from tablelift.operators.ordered import running
from tablelift.queries.catalogs import on_duckdb, on_spark
from tablelift.queries.data import table
from tablelift.session import new_run_dir
from tablelift.streaming.progress import open_jobs, run_progress

ORDER = ["ts", "event_id"]

# Workflows read as logs of the workflow graph: each event names the state that its number among the workflow's
# events would reach on a sound run; some events skip, repeat, fail or cancel.
_RUN = (
    "DRAFT", "DISCOVERED", "MAPPING_PROPOSED", "MAPPING_APPROVED", "STAGING", "STAGED", "EXECUTION_READY", "EXECUTING",
    "EXECUTED", "VALIDATION_READY", "VALIDATING", "VALIDATED",
)
_RARE = (
    "FAILED", "CANCELLED", "STAGING_RECOVERY_REQUIRED", "EXECUTION_RECOVERY_REQUIRED", "VALIDATION_RECOVERY_REQUIRED",
    "VALIDATION_REVIEW_REQUIRED", "MAPPING_APPROVED", "EXECUTION_READY",
)

_ARTIFACTS_SQL = """
    SELECT user_id AS workflow_id, event_type AS artifact_type, event_id AS artifact_version, ts AS created_at,
           props AS payload
    FROM {events}
"""

_REQUESTS_SQL = """
    SELECT user_id AS workflow_id, concat(user_id, ':', event_type, ':', CAST(ts AS DATE)) AS idempotency_key, props
    FROM {events}
"""

_AUDIT_SQL = """
    SELECT user_id AS workflow_id, event_id, ts, event_type AS new_status,
           CASE WHEN event_id % 5 = 0 THEN 'view' ELSE event_type END AS previous_status,
           CAST(floor(event_id / 100) AS BIGINT) AS workflow_version
    FROM {events}
"""

_SHAPES_SQL = """
    SELECT event_id,
           CASE event_id % 6 WHEN 0 THEN 'WORKFLOW_CREATED' WHEN 1 THEN 'ARTIFACT_APPENDED' WHEN 2 THEN 'STATUS_CHANGED'
                WHEN 3 THEN 'WORKFLOW_FAILED' WHEN 4 THEN 'WORKFLOW_CANCELLED' ELSE 'OTHER' END AS kind,
           CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'DRAFT' ELSE 'STAGED' END AS previous,
           CASE event_type WHEN 'signup' THEN 'DRAFT' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'CANCELLED'
                WHEN 'click' THEN 'STAGED' END AS new,
           user_id % 3 = 0 AS has_artifact
    FROM {events}
"""

_JOBS_SQL = """
    SELECT o_orderkey AS job_id, o_custkey AS workflow_id, o_orderdate AS queued_at,
           CASE o_orderkey % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'SUCCEEDED'
                WHEN 3 THEN 'FAILED' ELSE 'REVIEW_REQUIRED' END AS status,
           CASE WHEN o_custkey % 11 = 0 THEN 'VALIDATING'
                ELSE CASE o_orderkey % 5 WHEN 0 THEN 'QUEUED' WHEN 2 THEN 'COMPLETED' ELSE 'STAGING' END END AS stage,
           CASE WHEN o_orderkey % 5 > 0 OR o_custkey % 13 = 0
                THEN o_orderdate + {minute} * (o_custkey % 7 - 1) END AS started_at,
           CASE WHEN o_orderkey % 5 > 1 THEN o_orderdate + {minute} * (o_custkey % 9) END AS completed_at,
           CASE WHEN o_orderkey % 5 > 1 THEN o_custkey % 19 - 1 END AS duration_ms,
           CASE WHEN o_orderkey % 5 > 2 THEN CASE WHEN o_custkey % 6 = 0 THEN 'not a code' ELSE 'LOAD_FAILED' END END
               AS failure_category
    FROM {orders}
"""

_LINEAGE_SQL = """
    SELECT l_orderkey AS workflow_id,
           CASE l_linenumber % 4 WHEN 0 THEN 'LOAD' WHEN 1 THEN 'EXECUTION' WHEN 2 THEN 'CLEANUP' ELSE 'VALIDATION' END
               AS kind,
           CASE WHEN l_partkey % 9 = 0 THEN 2 ELSE 1 END AS plan_version,
           CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE concat('stage_', l_orderkey) END AS relation,
           CASE WHEN l_suppkey % 10 = 0 THEN 'f2' ELSE 'f1' END AS plan_fingerprint
    FROM {lineitem}
"""


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def day(name="ts"):
    return F.date_trunc("day", F.col(name))


def sequence(spark, sf_dir):
    numbered = with_sequence(events(spark, sf_dir), "user_id", ORDER, day())
    return numbered.select("user_id", "event_id", "sequence_number")


def artifacts(spark, sf_dir):
    return on_spark(spark, sf_dir, _ARTIFACTS_SQL)


def latest(spark, sf_dir):
    return latest_per_type(artifacts(spark, sf_dir), ["workflow_id", "artifact_type"], ["created_at", "artifact_version"])


def stale(spark, sf_dir):
    """Every artifact is referenced by the job that wrote it; most references are out of date, and some name no artifact."""
    references = artifacts(spark, sf_dir).select(
        "workflow_id", "artifact_type", F.when(F.col("artifact_version") % 37 == 0, -F.col("artifact_version")).otherwise(F.col("artifact_version")).alias("artifact_version")
    )
    return stale_references(references, artifacts(spark, sf_dir))


def hash_audit(spark, sf_dir):
    """Payload hashes recomputed against a log in which one type was altered after hashing."""
    altered = F.when(F.col("artifact_type") == "error", F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    log = sealed(artifacts(spark, sf_dir)).withColumn("payload", altered)
    return hash_mismatches(log).select("workflow_id", "artifact_version", "payload_sha256")


def requests(spark, sf_dir):
    rows = on_spark(spark, sf_dir, _REQUESTS_SQL)
    return rows.withColumn("request_sha256", request_hash("APPEND", F.col("props")))


def workflow_states(spark, sf_dir):
    """Events with the workflow state they name."""
    numbered = with_sequence(events(spark, sf_dir), "user_id", ORDER, day())
    at = (F.col("sequence_number") - 1 + F.when(F.col("event_id") % 19 == 0, 1).otherwise(0)) % len(_RUN)
    run, rare = (F.expr(f"array({', '.join(map(repr, names))})") for names in (_RUN, _RARE))
    unusual = F.get(rare, (F.floor(F.col("event_id") / 7) % len(_RARE)).cast("int"))
    return numbered.withColumn("status", F.when(F.col("event_id") % 7 == 0, unusual).otherwise(F.get(run, at.cast("int"))))


def transitions(spark, sf_dir):
    """Changes that the graph of all workflow states does not allow."""
    broken = transition_violations(workflow_states(spark, sf_dir), "user_id", "status", ORDER, day(), WORKFLOW_TRANSITIONS)
    return broken.select("user_id", "event_id", "previous_status", "status")


def audit_log(spark, sf_dir):
    return on_spark(spark, sf_dir, _AUDIT_SQL)


def broken_chain(spark, sf_dir):
    breaks = chain_breaks(audit_log(spark, sf_dir), "workflow_id", ORDER, day())
    return breaks.select("workflow_id", "event_id", "previous_status", "actual_previous")


def gaps(spark, sf_dir):
    """Sequence numbers of a log from which every fiftieth event was lost."""
    numbered = with_sequence(events(spark, sf_dir), "user_id", ORDER, day())
    return sequence_gaps(numbered.filter(F.col("event_id") % 50 != 0), "user_id")


def versions(spark, sf_dir):
    breaks = version_breaks(audit_log(spark, sf_dir), "workflow_id", ORDER, day())
    return breaks.select("workflow_id", "event_id", "workflow_version", "previous_version")


def shapes(spark, sf_dir):
    rows = on_spark(spark, sf_dir, _SHAPES_SQL)
    valid = event_shape(F.col("kind"), F.col("previous"), F.col("new"), F.col("has_artifact"))
    return rows.select("event_id", "kind", F.coalesce(valid, F.lit(False)).alias("is_valid"))


def jobs(spark, sf_dir):
    return on_spark(spark, sf_dir, _JOBS_SQL.replace("{minute}", "INTERVAL '1' MINUTE"))


def lifecycle(spark, sf_dir):
    checked = job_violations(jobs(spark, sf_dir))
    return checked.select(
        "job_id",
        F.array_join("violations", ",").alias("violations"),
        duration_ms(F.col("started_at"), F.col("completed_at")).alias("elapsed_ms"),
    )


def stage_steps(spark, sf_dir):
    """Stage changes of the jobs of one workflow, in queue order, that skip or repeat a stage."""
    log = jobs(spark, sf_dir)
    chained = running(
        log, ["workflow_id"], ["queued_at", "job_id"], F.date_trunc("day", "queued_at"), previous={"previous_stage": "stage"}
    )
    allowed = is_allowed(F.col("previous_stage"), F.col("stage"), JOB_TRANSITIONS)
    return chained.filter(F.col("previous_stage").isNotNull()).select(
        "workflow_id", "job_id", "previous_stage", "stage", allowed.alias("is_allowed")
    )


def snapshots(spark, sf_dir):
    """Conversations as progress logs: one batch per turn, some snapshots damaged."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"), "turn", F.length("text").cast("bigint").alias("rows")
    )
    # Turns are cut into runs of four, so that a long conversation spreads over tasks.
    summed = running(
        turns, ["job_id"], ["turn"], F.floor(F.col("turn") / 4),
        totals={"rows_total": F.col("rows"), "batches": F.lit(1).cast("bigint")},
    )
    number = F.col("job_id") + F.col("turn")
    read = F.when(number % 9 == 0, F.col("rows")).otherwise(F.col("rows_total"))
    start = F.timestamp_seconds(F.lit(1704067200) + F.when(number % 17 == 0, F.lit(0)).otherwise(F.col("turn") * 60))
    return summed.select(
        "job_id",
        "turn",
        F.when(number % 11 == 0, F.lit(1).cast("bigint")).otherwise(F.col("batches")).alias("batches_completed"),
        read.alias("rows_read"),
        F.when(number % 7 == 0, read - 1).otherwise(read).alias("rows_written"),
        F.when(number % 13 != 0, 5000).cast("bigint").alias("total_rows_estimate"),
        start.cast("timestamp_ntz").alias("updated_at"),
    )


def cumulative(spark, sf_dir):
    frame = snapshots(spark, sf_dir)
    percent = percent_complete(F.col("rows_read"), F.col("total_rows_estimate"))
    return frame.select("job_id", "turn", "batches_completed", "rows_read", percent.alias("percent"))


def progress(spark, sf_dir):
    broken = progress_violations(snapshots(spark, sf_dir), "job_id", ["turn"], F.floor(F.col("turn") / 4))
    return broken.select("job_id", "turn", F.array_join("violations", ",").alias("violations"))


_STREAM_SQL = """
    SELECT conv_id AS job_id, CASE WHEN (conv_id + turn) % 11 = 0 THEN 1 ELSE turn + 1 END AS batches_completed,
           CASE WHEN (conv_id + turn) % 9 = 0 THEN 1 ELSE (turn + 1) * 500 END AS rows_read,
           CASE WHEN (conv_id + turn) % 7 = 0 THEN (turn + 1) * 500 - 1 ELSE (turn + 1) * 500 END AS rows_written,
           CASE WHEN (conv_id + turn) % 13 <> 0 THEN 5000 END AS total_rows_estimate,
           turn * 60 AS seconds, turn, max(turn) OVER (PARTITION BY conv_id) AS last_turn
    FROM {conversations}
"""


def _progress_streamed(spark, sf_dir):
    """Folders with the violations and the state of a stream of files, the later ones holding the later part of every job."""
    run = new_run_dir(spark, "progress")
    log = spark.sql(_STREAM_SQL, conversations=table(spark, sf_dir, "conversations")).select(
        *[F.col(name).cast("bigint") for name in ("job_id", "batches_completed", "rows_read", "rows_written", "total_rows_estimate")],
        F.timestamp_seconds(F.lit(1704067200) + F.col("seconds")).alias("updated_at"),
        # Every fifth job is still at work when the log ends.
        ((F.col("turn") == F.col("last_turn")) & (F.col("job_id") % 5 != 0)).alias("is_last"),
        "turn",
    )
    # The earlier turns are written first, so that later micro-batches hold later files.
    for condition in (F.col("turn") < 2, F.col("turn") >= 2):
        log.filter(condition).drop("turn").repartition(8, "job_id").write.mode("append").parquet(f"{run}/in")
    stream = spark.readStream.schema(log.drop("turn").schema).option("maxFilesPerTrigger", 8).parquet(f"{run}/in")
    hours = F.date_trunc("hour", F.col("updated_at"))
    run_progress(stream, f"{run}/out", f"{run}/state", f"{run}/checkpoint", finished=F.col("is_last"), bucket=hours)
    return f"{run}/out", f"{run}/state"


def progress_on_stream(spark, sf_dir):
    """All five progress rules on a stream."""
    found = spark.read.parquet(_progress_streamed(spark, sf_dir)[0])
    return found.select("job_id", "batches_completed", "rows_read", "violation")


def open_after_stream(spark, sf_dir):
    """What a stream still keeps at the end of the log: jobs without a last snapshot."""
    left = open_jobs(spark, _progress_streamed(spark, sf_dir)[1])
    return left.select("job_id", "batches_completed", "rows_read", "rows_written", "total_rows_estimate")


_BATCHES_SQL = f"""
    SELECT l_orderkey AS job_id, l_linenumber AS report, {{pick}} AS stage,
           CASE WHEN l_partkey % 17 = 0 THEN 0 ELSE l_linenumber END AS batches_completed,
           CASE WHEN l_partkey % 19 = 0 THEN 0 WHEN l_partkey % 23 = 0 THEN -5 ELSE l_linenumber * 100 END AS rows_read,
           CASE WHEN l_partkey % 13 = 0 THEN l_linenumber * 100 - 1 WHEN l_partkey % 23 = 0 THEN -5 WHEN l_partkey % 19 = 0 THEN 0
                ELSE l_linenumber * 100 END AS rows_written,
           CASE WHEN l_partkey % 3 <> 0 THEN 5000 END AS total_rows_estimate,
           CASE WHEN l_partkey % 29 <> 0 THEN o_orderdate + {{minute}} * (l_partkey % 12 - 2) END AS progress_updated_at
    FROM {{lineitem}} AS l JOIN {{orders}} AS o ON o.o_orderkey = l.l_orderkey - CASE WHEN l_suppkey % 41 = 0 THEN 1 ELSE 0 END
"""
_REPORTED_STAGES = ("STAGING", "TRANSFORMING", "EXECUTING", "CLEANING_UP", "VALIDATING", "COMPLETED", "QUEUED", "PREPARING")


def _batch_sql(minute: str) -> str:
    branches = " ".join(f"WHEN {n} THEN '{name}'" for n, name in enumerate(_REPORTED_STAGES))
    text = _BATCHES_SQL.replace("{pick}", f"CASE l_suppkey % {len(_REPORTED_STAGES)} {branches} END")
    return text.replace("{minute}", minute)


def batches(spark, sf_dir):
    return on_spark(spark, sf_dir, _batch_sql("INTERVAL '1' MINUTE"))


def batch_reports(spark, sf_dir):
    """Reports of batches that do not fit the time or the stage of their job."""
    broken = batch_progress_violations(jobs(spark, sf_dir), batches(spark, sf_dir))
    return broken.select("job_id", "report", "stage", F.array_join("violations", ",").alias("violations"))


QUERIES = {
    "event_sequence": sequence,
    "latest_per_type": latest,
    "stale_references": stale,
    "payload_hash_audit": hash_audit,
    "idempotency_conflicts": lambda spark, sf: idempotency(requests(spark, sf), ["workflow_id", "idempotency_key"]),
    "transition_violations": transitions,
    "chain_breaks": broken_chain,
    "chain_gaps": gaps,
    "version_breaks": versions,
    "event_shapes": shapes,
    "single_active_violations": lambda spark, sf: several_active(
        jobs(spark, sf), "workflow_id", F.col("status").isin("QUEUED", "RUNNING")
    ),
    "job_lifecycle": lifecycle,
    "job_stage_steps": stage_steps,
    "cumulative_progress": cumulative,
    "progress_violations": progress,
    "lineage_check": lambda spark, sf: lineage(on_spark(spark, sf, _LINEAGE_SQL), "workflow_id"),
    "oldest_queued": lambda spark, sf: oldest_queued(jobs(spark, sf)).select("job_id", "workflow_id", "queued_at"),
    "event_page": lambda spark, sf: page(events(spark, sf), ["ts", "event_id"], 100, 250),
    "stream_progress_check": progress_on_stream,
    "stream_open_jobs": open_after_stream,
    "batch_progress_violations": batch_reports,
    "batch_stage_spans": lambda spark, sf: stage_gaps(jobs(spark, sf), batches(spark, sf)),
}

_JOBS_DUCK = on_duckdb(_JOBS_SQL.replace("{minute}", "INTERVAL 1 MINUTE"))
_AUDIT_DUCK = on_duckdb(_AUDIT_SQL)
_ALLOWED = ", ".join(f"('{old}', '{new}')" for old, followers in WORKFLOW_TRANSITIONS.items() for new in followers)
_STAGES = ", ".join(f"('{old}', '{new}')" for old, followers in JOB_TRANSITIONS.items() for new in followers)

_SNAPSHOTS_DUCK = """
    SELECT job_id, turn, CASE WHEN (job_id + turn) % 11 = 0 THEN 1 ELSE batches END AS batches_completed,
           rows_read, CASE WHEN (job_id + turn) % 7 = 0 THEN rows_read - 1 ELSE rows_read END AS rows_written,
           CASE WHEN (job_id + turn) % 13 <> 0 THEN 5000 END AS total_rows_estimate,
           CASE WHEN (job_id + turn) % 17 = 0 THEN 0 ELSE turn * 60 END AS updated_at
    FROM (SELECT conv_id AS job_id, turn, count(*) OVER w AS batches,
                 CASE WHEN (conv_id + turn) % 9 = 0 THEN length(text) ELSE CAST(sum(length(text)) OVER w AS BIGINT) END
                     AS rows_read
          FROM conversations
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS s
"""

ORACLES = {
    "event_sequence": """
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_number
        FROM events
    """,
    "latest_per_type": f"""
        SELECT * FROM ({on_duckdb(_ARTIFACTS_SQL)}) AS a
        QUALIFY row_number() OVER (PARTITION BY workflow_id, artifact_type
                                   ORDER BY created_at DESC, artifact_version DESC) = 1
    """,
    "stale_references": """
        SELECT * FROM (
            SELECT user_id AS workflow_id, event_type AS artifact_type,
                   CASE WHEN event_id % 37 = 0 THEN -event_id ELSE event_id END AS artifact_version,
                   max(event_id) OVER (PARTITION BY user_id, event_type) AS latest_version
            FROM events) AS e
        WHERE artifact_version <> latest_version
    """,
    "payload_hash_audit": """
        SELECT user_id AS workflow_id, event_id AS artifact_version, sha256(props) AS payload_sha256
        FROM events WHERE event_type = 'error'
    """,
    "idempotency_conflicts": f"""
        SELECT workflow_id, idempotency_key, count(*) AS requests,
               CASE WHEN count(DISTINCT props) > 1 THEN 'CONFLICT' WHEN count(*) > 1 THEN 'REPLAY' ELSE 'FIRST' END
                   AS outcome
        FROM ({on_duckdb(_REQUESTS_SQL)}) AS r GROUP BY ALL
    """,
    "transition_violations": f"""
        SELECT user_id, event_id, previous_status, status FROM (
            SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM (
                SELECT user_id, event_id, ts,
                       CASE WHEN event_id % 7 = 0 THEN {list(_RARE)}[CAST(event_id // 7 % {len(_RARE)} AS INTEGER) + 1]
                            ELSE {list(_RUN)}[CAST((n - 1 + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) % {len(_RUN)} AS INTEGER) + 1] END AS status
                FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) AS e) AS s) AS c
        WHERE previous_status IS NOT NULL AND (previous_status, status) NOT IN ({_ALLOWED})
    """,
    "chain_breaks": f"""
        SELECT * FROM (
            SELECT workflow_id, event_id, previous_status,
                   lag(new_status) OVER (PARTITION BY workflow_id ORDER BY ts, event_id) AS actual_previous
            FROM ({_AUDIT_DUCK}) AS a) AS c
        WHERE actual_previous IS NOT NULL AND previous_status <> actual_previous
    """,
    "chain_gaps": """
        SELECT user_id, count(*) AS events, min(n) AS first_number, max(n) AS last_number
        FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
              FROM events) AS e
        WHERE event_id % 50 <> 0 GROUP BY user_id HAVING min(n) <> 1 OR max(n) <> count(*)
    """,
    "version_breaks": f"""
        SELECT * FROM (
            SELECT workflow_id, event_id, workflow_version,
                   lag(workflow_version) OVER (PARTITION BY workflow_id ORDER BY ts, event_id) AS previous_version
            FROM ({_AUDIT_DUCK}) AS a) AS c
        WHERE workflow_version - previous_version NOT IN (0, 1)
    """,
    "event_shapes": f"""
        SELECT event_id, kind, coalesce(CASE kind
                   WHEN 'WORKFLOW_CREATED' THEN previous IS NULL AND coalesce(new = 'DRAFT', false) AND NOT has_artifact
                   WHEN 'ARTIFACT_APPENDED' THEN has_artifact AND coalesce(previous = new, false)
                   WHEN 'STATUS_CHANGED' THEN NOT has_artifact AND previous IS NOT NULL AND new IS NOT NULL
                                              AND new NOT IN ('FAILED', 'CANCELLED')
                   WHEN 'WORKFLOW_FAILED' THEN NOT has_artifact AND previous IS NOT NULL AND new = 'FAILED'
                   WHEN 'WORKFLOW_CANCELLED' THEN NOT has_artifact AND previous IS NOT NULL AND new = 'CANCELLED'
                   ELSE false END, false) AS is_valid
        FROM ({on_duckdb(_SHAPES_SQL)}) AS s
    """,
    "single_active_violations": f"""
        SELECT workflow_id, count(*) FILTER (WHERE status IN ('QUEUED', 'RUNNING')) AS active
        FROM ({_JOBS_DUCK}) AS j GROUP BY workflow_id
        HAVING count(*) FILTER (WHERE status IN ('QUEUED', 'RUNNING')) > 1
    """,
    "job_lifecycle": f"""
        SELECT job_id, concat_ws(',',
                   CASE WHEN started_at < queued_at THEN 'STARTED_BEFORE_QUEUED' END,
                   CASE WHEN completed_at IS NOT NULL AND (started_at IS NULL OR completed_at < started_at)
                        THEN 'COMPLETED_BEFORE_STARTED' END,
                   CASE WHEN duration_ms < 0 THEN 'NEGATIVE_DURATION' END,
                   CASE WHEN failure_category = 'not a code' THEN 'INVALID_FAILURE_CATEGORY' END,
                   CASE WHEN NOT (CASE status
                       WHEN 'QUEUED' THEN stage = 'QUEUED' AND started_at IS NULL AND completed_at IS NULL
                                          AND duration_ms IS NULL AND failure_category IS NULL
                       WHEN 'RUNNING' THEN stage NOT IN ('QUEUED', 'COMPLETED') AND started_at IS NOT NULL
                                           AND completed_at IS NULL AND duration_ms IS NULL AND failure_category IS NULL
                       WHEN 'SUCCEEDED' THEN stage = 'COMPLETED' AND started_at IS NOT NULL AND completed_at IS NOT NULL
                                             AND duration_ms IS NOT NULL AND failure_category IS NULL
                       ELSE stage NOT IN ('QUEUED', 'COMPLETED') AND started_at IS NOT NULL AND completed_at IS NOT NULL
                            AND duration_ms IS NOT NULL AND failure_category IS NOT NULL END)
                        THEN 'LIFECYCLE_INCONSISTENT' END) AS violations,
               greatest(0, CASE WHEN started_at IS NOT NULL AND completed_at IS NOT NULL
                                THEN epoch_ms(completed_at) - epoch_ms(started_at) END) AS elapsed_ms
        FROM ({_JOBS_DUCK}) AS j
    """,
    "job_stage_steps": f"""
        SELECT workflow_id, job_id, previous_stage, stage, (previous_stage, stage) IN ({_STAGES}) AS is_allowed
        FROM (SELECT workflow_id, job_id, stage,
                     lag(stage) OVER (PARTITION BY workflow_id ORDER BY queued_at, job_id) AS previous_stage
              FROM ({_JOBS_DUCK}) AS j) AS s
        WHERE previous_stage IS NOT NULL
    """,
    "cumulative_progress": f"""
        SELECT job_id, turn, batches_completed, rows_read,
               CASE WHEN total_rows_estimate IS NOT NULL
                    THEN least(100, rows_read * 100 // total_rows_estimate) END AS percent
        FROM ({_SNAPSHOTS_DUCK}) AS s
    """,
    "progress_violations": f"""
        SELECT job_id, turn, violations FROM (
            SELECT job_id, turn, concat_ws(',',
                       CASE WHEN rows_read <> rows_written OR (batches_completed = 0) <> (rows_read = 0)
                            THEN 'INCONSISTENT_COUNTS' END,
                       CASE WHEN batches_completed <= lag(batches_completed) OVER w THEN 'BATCHES_NOT_GROWING' END,
                       CASE WHEN rows_read <= lag(rows_read) OVER w OR rows_written <= lag(rows_written) OVER w
                            THEN 'ROWS_NOT_GROWING' END,
                       CASE WHEN updated_at <= lag(updated_at) OVER w THEN 'TIME_NOT_GROWING' END,
                       CASE WHEN lag(turn) OVER w IS NOT NULL
                             AND total_rows_estimate IS DISTINCT FROM lag(total_rows_estimate) OVER w
                            THEN 'ESTIMATE_CHANGED' END) AS violations
            FROM ({_SNAPSHOTS_DUCK}) AS s WINDOW w AS (PARTITION BY job_id ORDER BY turn)) AS v
        WHERE violations <> ''
    """,
    "lineage_check": f"""
        SELECT workflow_id, missing, same_plan_version, same_relation, same_plan_fingerprint,
               missing = '' AND same_plan_version AND same_relation AND same_plan_fingerprint AS proven
        FROM (
            SELECT workflow_id,
                   concat_ws(',', CASE WHEN count(*) FILTER (WHERE kind = 'LOAD') = 0 THEN 'LOAD' END,
                             CASE WHEN count(*) FILTER (WHERE kind = 'EXECUTION') = 0 THEN 'EXECUTION' END,
                             CASE WHEN count(*) FILTER (WHERE kind = 'CLEANUP') = 0 THEN 'CLEANUP' END,
                             CASE WHEN count(*) FILTER (WHERE kind = 'VALIDATION') = 0 THEN 'VALIDATION' END) AS missing,
                   count(DISTINCT plan_version) = 1 AS same_plan_version,
                   count(DISTINCT coalesce(relation, '')) = 1 AS same_relation,
                   count(DISTINCT plan_fingerprint) = 1 AS same_plan_fingerprint
            FROM ({on_duckdb(_LINEAGE_SQL)}) AS l GROUP BY workflow_id) AS g
    """,
    "oldest_queued": """
        SELECT o_orderkey AS job_id, o_custkey AS workflow_id, o_orderdate AS queued_at
        FROM orders WHERE o_orderkey % 5 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 1
    """,
    "event_page": "SELECT * FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 250",
    "stream_progress_check": f"""
        SELECT job_id, batches_completed, rows_read, unnest(list_filter([
                   CASE WHEN rows_read <> rows_written OR (batches_completed = 0) <> (rows_read = 0) THEN 'INCONSISTENT_COUNTS' END,
                   CASE WHEN batches_completed <= lag(batches_completed) OVER w THEN 'BATCHES_NOT_GROWING' END,
                   CASE WHEN rows_read <= lag(rows_read) OVER w OR rows_written <= lag(rows_written) OVER w THEN 'ROWS_NOT_GROWING' END,
                   CASE WHEN seconds <= lag(seconds) OVER w THEN 'TIME_NOT_GROWING' END,
                   CASE WHEN lag(turn) OVER w IS NOT NULL
                         AND total_rows_estimate IS DISTINCT FROM lag(total_rows_estimate) OVER w THEN 'ESTIMATE_CHANGED' END
               ], lambda x: x IS NOT NULL)) AS violation
        FROM ({_STREAM_SQL.replace("{conversations}", "conversations")}) AS s
        WINDOW w AS (PARTITION BY job_id ORDER BY turn)
    """,
    "stream_open_jobs": f"""
        SELECT job_id, batches_completed, rows_read, rows_written, total_rows_estimate
        FROM ({_STREAM_SQL.replace("{conversations}", "conversations")}) AS s WHERE turn = last_turn AND job_id % 5 = 0
    """,
    "batch_progress_violations": f"""
        SELECT * FROM (
            SELECT b.job_id, report, b.stage, concat_ws(',',
                       CASE WHEN j.job_id IS NULL THEN 'UNKNOWN_JOB' END,
                       CASE WHEN progress_updated_at IS NULL THEN 'MISSING_TIME' END,
                       CASE WHEN j.job_id IS NOT NULL AND started_at IS NULL THEN 'NOT_STARTED' END,
                       CASE WHEN progress_updated_at < started_at THEN 'BEFORE_START' END,
                       CASE WHEN progress_updated_at > completed_at THEN 'AFTER_END' END,
                       CASE WHEN b.stage NOT IN {PROGRESS_STAGES} THEN 'ILLEGAL_STAGE' END,
                       CASE WHEN least(rows_read, rows_written) < 0 THEN 'NEGATIVE_COUNT' END,
                       CASE WHEN rows_read <> rows_written THEN 'COUNTS_DIFFER' END,
                       CASE WHEN (batches_completed = 0) <> (rows_read = 0) THEN 'BATCHES_WITHOUT_ROWS' END) AS violations
            FROM ({on_duckdb(_batch_sql("INTERVAL 1 MINUTE"))}) AS b LEFT JOIN ({_JOBS_DUCK}) AS j USING (job_id)) AS v
        WHERE violations <> ''
    """,
    "batch_stage_spans": f"""
        SELECT job_id, stage, reports, first_at, last_at,
               coalesce(first_at >= started_at AND (completed_at IS NULL OR last_at IS NULL OR last_at <= completed_at), false) AS is_contained
        FROM (SELECT job_id, stage, count(*) AS reports, min(progress_updated_at) AS first_at, max(progress_updated_at) AS last_at
              FROM ({on_duckdb(_batch_sql("INTERVAL 1 MINUTE"))}) AS b GROUP BY ALL) AS c
        JOIN (SELECT job_id, started_at, completed_at FROM ({_JOBS_DUCK}) AS j) AS j USING (job_id)
    """,
}
