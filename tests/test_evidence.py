"""Running values with hot keys, log checks and the stateful progress stream."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablelift.operators.evidence import (
    JOB_TRANSITIONS, WORKFLOW_TRANSITIONS, append, batch_progress_violations, hash_mismatches, idempotency, is_allowed, job_violations, lineage, percent_complete,
    progress_violations, stage_gaps, transition_violations, with_sequence,
)
from tablelift.operators.ordered import running
from tablelift.session import new_run_dir
from tablelift.streaming.progress import open_jobs, run_progress

START = dt.datetime(2024, 1, 1)


def hot_log(spark, rows=5000):
    """Half of all rows belong to key 0, and some buckets of it are empty."""
    n = F.col("id")
    return spark.range(rows).select(
        F.when(n % 2 == 0, 0).otherwise(n % 50).alias("key"),
        F.timestamp_seconds(F.lit(1704067200) + n * 37 + F.when(n > 2500, 400000).otherwise(0)).alias("at"),
        n.alias("event"),
        (n % 7).alias("amount"),
        F.when(n % 5 > 0, n % 3).alias("state"),
    )


def test_running_equals_plain_windows(spark):
    log = hot_log(spark).repartition(9)
    got = running(
        log, ["key"], ["at", "event"], F.date_trunc("hour", "at"),
        totals={"n": F.lit(1).cast("bigint"), "total": F.col("amount")},
        previous={"before": "state", "before_event": "event"},
    )
    w = Window.partitionBy("key").orderBy("at", "event")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = log.select(
        "*", F.row_number().over(w).cast("bigint").alias("n"), F.sum("amount").over(whole).alias("total"),
        F.lag("state").over(w).alias("before"), F.lag("event").over(w).alias("before_event"),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_no_window_partition_holds_a_whole_hot_key(spark):
    text = with_sequence(hot_log(spark), "key", ["at", "event"], F.date_trunc("hour", "at"))
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan.split("row_number")[0] and plan.count("Exchange hashpartitioning(key") >= 1


def test_transition_graph(spark):
    assert len(WORKFLOW_TRANSITIONS) == 18
    frame = spark.createDataFrame(
        [("DRAFT", "DISCOVERED"), ("VALIDATED", "FAILED"), ("STAGING", "FAILED"), ("EXECUTED", "VALIDATING")],
        "old string, new string",
    )
    got = frame.select(is_allowed(F.col("old"), F.col("new"), WORKFLOW_TRANSITIONS)).collect()
    assert [row[0] for row in got] == [True, False, False, True]
    assert JOB_TRANSITIONS["COMPLETED"] == [] and JOB_TRANSITIONS["QUEUED"] == ["PREPARING"]


def test_transition_violations(spark):
    states = ["DRAFT", "DISCOVERED", "MAPPING_PROPOSED", "STAGING", "FAILED"]
    log = spark.createDataFrame(
        [("w", START + dt.timedelta(days=n), state) for n, state in enumerate(states)], "w string, at timestamp, state string"
    )
    got = transition_violations(log, "w", "state", ["at"], F.date_trunc("day", "at"), WORKFLOW_TRANSITIONS).collect()
    assert [(row.previous_status, row.state) for row in got] == [("MAPPING_PROPOSED", "STAGING"), ("STAGING", "FAILED")]


def test_idempotency_outcomes(spark):
    rows = [("a", "h1"), ("a", "h1"), ("b", "h1"), ("b", "h2"), ("c", "h1")]
    frame = spark.createDataFrame(rows, "key string, request_sha256 string")
    assert {row.key: row.outcome for row in idempotency(frame, ["key"]).collect()} == {
        "a": "REPLAY", "b": "CONFLICT", "c": "FIRST",
    }


def test_log_is_appended_and_checked(spark):
    log = new_run_dir(spark, "log-test")
    for batch in ([("a", "{}")], [("b", '{"x":1}')]):
        append(spark.createDataFrame(batch, "id string, payload string"), log)
    stored = spark.read.parquet(log)
    assert stored.count() == 2 and hash_mismatches(stored).count() == 0
    changed = stored.withColumn("payload", F.when(F.col("id") == "a", "[]").otherwise(F.col("payload")))
    assert [row.id for row in hash_mismatches(changed).collect()] == ["a"]


def test_lineage(spark):
    kinds = ["LOAD", "EXECUTION", "CLEANUP", "VALIDATION"]
    rows = [("good", kind, 1, "r", "f") for kind in kinds] + [("short", kind, 1, "r", "f") for kind in kinds[:3]]
    rows += [("version", kind, 1 + (kind == "LOAD"), "r", "f") for kind in kinds]
    rows += [("null", kind, 1, None if kind == "LOAD" else "r", "f") for kind in kinds]
    frame = spark.createDataFrame(
        rows, "run string, kind string, plan_version int, relation string, plan_fingerprint string"
    )
    got = {row.run: row for row in lineage(frame, "run").collect()}
    assert {run: row.proven for run, row in got.items()} == {"good": True, "short": False, "version": False, "null": False}
    assert got["short"].missing == "VALIDATION" and not got["version"].same_plan_version and not got["null"].same_relation


def test_job_rules(spark):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [
        (1, "QUEUED", "QUEUED", day(0), None, None, None, None), (2, "QUEUED", "QUEUED", day(0), day(1), None, None, None),
        (3, "SUCCEEDED", "COMPLETED", day(0), day(1), day(2), 5, None),
        (4, "FAILED", "STAGING", day(0), day(1), day(0), 5, "bad code"),
    ]
    frame = spark.createDataFrame(
        rows,
        "job_id int, status string, stage string, queued_at timestamp, started_at timestamp, completed_at timestamp,"
        " duration_ms int, failure_category string",
    )
    assert {row.job_id: row.violations for row in job_violations(frame).collect()} == {
        1: [], 2: ["LIFECYCLE_INCONSISTENT"], 3: [], 4: ["COMPLETED_BEFORE_STARTED", "INVALID_FAILURE_CATEGORY"],
    }


SNAPSHOTS = "job_id bigint, batches_completed bigint, rows_read bigint, rows_written bigint, total_rows_estimate bigint, updated_at timestamp"


def snapshot_rows():
    at = lambda n: START + dt.timedelta(seconds=n)
    return [
        (1, 1, 500, 500, 1200, at(1)), (1, 2, 1000, 1000, 1200, at(2)), (2, 1, 500, 500, 1200, at(1)),
        (2, 1, 500, 500, 1200, at(2)), (3, 1, 500, 500, 1200, at(1)), (3, 2, 1000, 1000, 1300, at(2)),
        (4, 1, 500, 499, None, at(1)), (4, 2, 600, 600, None, at(2)),
    ]


def test_progress_rules(spark):
    frame = spark.createDataFrame(snapshot_rows(), SNAPSHOTS)
    got = progress_violations(frame, "job_id", ["updated_at"], F.date_trunc("second", "updated_at")).collect()
    assert {(row.job_id, row.batches_completed): row.violations for row in got} == {
        (2, 1): ["BATCHES_NOT_GROWING", "ROWS_NOT_GROWING"], (3, 2): ["ESTIMATE_CHANGED"], (4, 1): ["INCONSISTENT_COUNTS"],
    }


def test_progress_stream_keeps_state_between_batches(spark):
    run = new_run_dir(spark, "progress-test")
    frame = spark.createDataFrame(snapshot_rows(), SNAPSHOTS)
    for second in (1, 2):
        frame.filter(F.second("updated_at") == second).coalesce(1).write.mode("append").parquet(f"{run}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")
    run_progress(stream, f"{run}/out", f"{run}/state", f"{run}/checkpoint", finished=F.lit(False))
    streamed = sorted((row.job_id, row.batches_completed, row.violation) for row in spark.read.parquet(f"{run}/out").collect())
    batch = progress_violations(frame, "job_id", ["updated_at"], F.date_trunc("second", "updated_at")).collect()
    assert streamed == sorted((row.job_id, row.batches_completed, code) for row in batch for code in row.violations)
    assert {row[2] for row in streamed} >= {"INCONSISTENT_COUNTS", "ESTIMATE_CHANGED", "ROWS_NOT_GROWING"}


def arrived(spark, run, rows):
    schema = "job_id bigint, batches_completed bigint, rows_read bigint, rows_written bigint, total_rows_estimate bigint, second int, ended boolean"
    frame = spark.createDataFrame([(job, n, n * 10, n * 10, 100, second, ended) for job, n, second, ended in rows], schema)
    frame = frame.withColumn("updated_at", F.timestamp_seconds(F.lit(1704067200) + F.col("second"))).drop("second")
    frame.coalesce(1).write.mode("append").parquet(f"{run}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{run}/in")
    run_progress(stream, f"{run}/out", f"{run}/state", f"{run}/checkpoint", finished=F.col("ended"), idle=dt.timedelta(seconds=100))


def test_a_late_snapshot_does_not_replace_a_newer_one(spark):
    run = new_run_dir(spark, "progress-late")
    for batches, second in ((5, 5), (3, 3), (6, 6)):
        arrived(spark, run, [(9, batches, second, False)])
    got = sorted((row.batches_completed, row.violation) for row in spark.read.parquet(f"{run}/out").collect())
    assert got == [(3, "BATCHES_NOT_GROWING"), (3, "ROWS_NOT_GROWING"), (3, "TIME_NOT_GROWING")]
    assert [row.batches_completed for row in open_jobs(spark, f"{run}/state").collect()] == [6]


def test_finished_and_silent_jobs_leave_the_state(spark):
    run = new_run_dir(spark, "progress-end")
    arrived(spark, run, [(1, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False)])
    arrived(spark, run, [(1, 2, 50, True), (2, 2, 50, False)])
    assert {row.job_id for row in open_jobs(spark, f"{run}/state").collect()} == {2, 3}
    arrived(spark, run, [(2, 3, 140, False)])
    assert {row.job_id for row in open_jobs(spark, f"{run}/state").collect()} == {2}
    versions = spark.sparkContext._jvm.java.io.File(f"{run}/state".removeprefix("file:")).list()
    assert len(versions) == 2 and spark.read.parquet(f"{run}/out").count() == 0


def test_batch_reports_outside_of_their_job(spark):
    at = [START + dt.timedelta(minutes=n) for n in range(6)]
    jobs = spark.createDataFrame([(1, at[1], at[3]), (2, at[1], None), (3, None, None)], "job_id bigint, started_at timestamp, completed_at timestamp")
    rows = [
        (1, "STAGING", 1, 5, 5, 9, at[1]), (1, "STAGING", 2, 6, 6, 9, at[3]), (1, "QUEUED", 2, 6, 6, 9, at[0]), (1, "COMPLETED", 0, 6, 7, None, at[4]),
        (2, "EXECUTING", 0, 0, 0, None, at[5]), (3, "STAGING", 1, 1, 1, None, at[1]), (4, "STAGING", 1, -1, -1, None, None),
    ]
    schema = "job_id bigint, stage string, batches_completed bigint, rows_read bigint, rows_written bigint, total_rows_estimate bigint, progress_updated_at timestamp"
    batches = spark.createDataFrame(rows, schema)
    got = sorted((row.job_id, row.stage, row.violations) for row in batch_progress_violations(jobs, batches).collect())
    assert got == [
        (1, "COMPLETED", ["AFTER_END", "COUNTS_DIFFER", "BATCHES_WITHOUT_ROWS"]), (1, "QUEUED", ["BEFORE_START", "ILLEGAL_STAGE"]),
        (3, "STAGING", ["NOT_STARTED"]), (4, "STAGING", ["UNKNOWN_JOB", "MISSING_TIME", "NEGATIVE_COUNT"]),
    ]
    spans = {(row.job_id, row.stage): row.is_contained for row in stage_gaps(jobs, batches).collect()}
    assert spans == {(1, "STAGING"): True, (1, "QUEUED"): False, (1, "COMPLETED"): False, (2, "EXECUTING"): True, (3, "STAGING"): False}


@pytest.mark.parametrize("read,estimate,expected", [(5, None, None), (5, 0, 100), (1, 3, 33), (9, 3, 100), (0, 7, 0)])
def test_percent(spark, read, estimate, expected):
    frame = spark.createDataFrame([(read, estimate)], "r bigint, e bigint")
    assert frame.select(percent_complete(F.col("r"), F.col("e"))).first()[0] == expected
