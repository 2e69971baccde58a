"""Session helpers: settings the operators rely on and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}


def assert_session(spark: SparkSession) -> None:
    """Fail early when casts or timestamps would not mean what the plan says."""
    if spark.conf.get("spark.sql.ansi.enabled", "true") != "true":
        raise ValueError("spark.sql.ansi.enabled must be true: lossy casts must fail, not return NULL.")
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "UCT", "GMT", "Z", "+00:00"):
        raise ValueError("spark.sql.session.timeZone must be UTC: canonical times are UTC.")


#: Bytes of bytecode from which on the JVM leaves a method uncompiled.
_JIT_LIMIT = "8000"


def small_methods(spark: SparkSession) -> None:
    """Generate code in methods that the JVM compiles, unless the session says otherwise.

    A wide projection of catalog rules, fused into one method, grows beyond what the JVM compiles and runs interpreted.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", _JIT_LIMIT)


#: Bytes of shuffled data one task reads, and buckets of a shuffle, of which small ones are read together.
_TASK_BYTES, _BUCKETS = "4m", "800"


#: Whether rows that lie together by some keys of a join are sent again to lie together by all of them.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def small_partitions(spark: SparkSession) -> None:
    """Let a task that joins or sorts hold little, and rows stay where they are, unless the session says otherwise.

    Catalog rows unpack to many times their shuffled size and a task sorts several sides of them, so that the usual size
    of a partition, and as many of them as there are cores, make tasks that grow with the input until they spill. Rows that lie
    together by table are joined there by table and column.
    """
    advisory, initial = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(advisory).lower() in ("64mb", "64m", "67108864b", "67108864"):
        spark.conf.set(advisory, _TASK_BYTES)
    if spark.conf.get("spark.sql.shuffle.partitions") == "200" and not spark.conf.get(initial, None):
        spark.conf.set(initial, _BUCKETS)
    if spark.conf.get(_ALL_KEYS) == "true":
        spark.conf.set(_ALL_KEYS, "false")


#: Bytes of rows that Spark hands to Python at once. The JVM and Python both hold them more than once.
_BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Let a Python task hold few rows at once, unless the session says otherwise; a longer row is a batch of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is unset, a folder below the warehouse, which every executor reaches too.
    """
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tablelift"


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one; never reused, so writes never overwrite."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def discard_written(spark: SparkSession) -> int:
    """Remove the folders that this application wrote between steps, once no frame made from them is used any more."""
    folders = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back: lineage is cut, lost executors cost nothing."""
    path = new_run_dir(frame.sparkSession, label)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
