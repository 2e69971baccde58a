"""Progress checks on a stream: the last snapshot of every unfinished job is kept between micro-batches.

The state is a small table with one version per micro-batch, not a store inside the executors: a micro-batch reads the
version before its own, checks its snapshots and the kept ones together with the columnar rules of the batch check, and
writes the next version. A repeated micro-batch reads and writes the same folders again, so nothing is counted
twice. A job leaves the state with its last snapshot, or when nothing was heard of it for too long.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelift.operators.evidence import PROGRESS_COLUMNS, snapshot_violations
from tablelift.operators.ordered import running

#: What is kept of a job.
KEPT = ("job_id", *PROGRESS_COLUMNS)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that were written to the end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [status.getPath() for status in system.listStatus(path)]
    return sorted(int(one.getName().split("=")[1]) for one in names if system.exists(hadoop.Path(one, "_SUCCESS")))


def _dropped(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def check_batch(
    arrived: DataFrame, kept: DataFrame | None, finished: Column, idle: timedelta | None, bucket: Column
) -> tuple[DataFrame, DataFrame]:
    """(violations of the arrived snapshots, state afterwards).

    Snapshots of a job are compared in the order of their time, the first with the kept one. The newest by its own time is
    kept, so a snapshot that comes late is reported but never replaces a newer one.
    """
    frame = arrived.select(*KEPT, finished.alias("finished"), F.lit(False).alias("kept"))
    if kept is not None:
        frame = frame.unionByName(kept.select(*KEPT, F.lit(False).alias("finished"), F.lit(True).alias("kept")))
    newest = ["updated_at", "batches_completed", "rows_read", "rows_written"]
    # What is kept stands before everything that arrived, whatever its time.
    order = ["arrived", *newest]
    frame = frame.withColumn("arrived", ~F.col("kept"))
    bucket = F.when(F.col("arrived"), bucket).otherwise(F.lit("0001-01-01").cast("timestamp"))
    names = {f"previous_{name}": name for name in PROGRESS_COLUMNS} | {"previous_kept": "kept"}
    chained = running(frame, ["job_id"], order, bucket, previous=names)
    before = {name: F.col(f"previous_{name}") for name in PROGRESS_COLUMNS}
    codes = snapshot_violations(before, {name: F.col(name) for name in PROGRESS_COLUMNS}, F.col("previous_kept").isNotNull())
    violations = chained.filter(~F.col("kept")).select(*KEPT, F.explode(codes).alias("violation"))
    last = frame.groupBy("job_id").agg(
        F.max_by(F.struct(*KEPT[1:]), F.struct(*newest)).alias("last"), F.bool_or("finished").alias("finished")
    )
    left = last.filter(~F.col("finished")).select("job_id", "last.*")
    if idle is not None:
        (latest,) = frame.agg(F.max("updated_at")).first()
        if latest is not None:
            left = left.filter(F.col("updated_at") >= F.lit(latest - idle))
    return violations, left


def run_progress(
    snapshots: DataFrame,
    output: str,
    state: str,
    checkpoint: str,
    *,
    finished: Column,
    idle: timedelta | None = None,
    bucket: Column | None = None,
) -> None:
    """Check everything available of a stream of snapshots, append violations to ``output``, keep the state in ``state``.

    Snapshots hold job_id and the progress columns. ``finished`` marks the last snapshot of a job, ``idle`` is how long a
    job may be silent before it is let go, ``bucket`` cuts long jobs into parts of time (days by default).
    """
    by_time = F.date_trunc("day", F.col("updated_at")) if bucket is None else bucket

    def work_off(arrived: DataFrame, number: int) -> None:
        spark = arrived.sparkSession
        done = [version for version in _versions(spark, state) if version < number]
        kept = spark.read.parquet(f"{state}/version={done[-1]}") if done else None
        violations, left = check_batch(arrived, kept, finished, idle, by_time)
        violations.write.mode("overwrite").parquet(f"{output}/batch={number}")
        left.write.mode("overwrite").parquet(f"{state}/version={number}")
        # The version before is kept for a repeat of this batch.
        for version in done[:-1]:
            _dropped(spark, f"{state}/version={version}")

    query = (
        snapshots.writeStream.foreachBatch(work_off).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def open_jobs(spark: SparkSession, state: str) -> DataFrame:
    """The newest state: last snapshots of the jobs that have not ended."""
    return spark.read.parquet(f"{state}/version={_versions(spark, state)[-1]}")
