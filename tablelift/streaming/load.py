"""Incremental load: bounded micro-batches, each written under its own batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.operators.projection import project
from tablelift.plans.plan import Plan


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int) -> DataFrame:
    """Parquet files of a folder as a stream; the bound of a batch is in files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def load_stream(stream: DataFrame, plan: Plan, output: str, checkpoint: str) -> None:
    """Project every micro-batch into ``output/rows/batch_id=<id>``, then confirm it in ``output/log``.

    A repeated batch overwrites its own folders, so a retry cannot duplicate rows,
    and progress is only reported for rows that are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        observed = Observation()
        counted = batch.observe(observed, F.count(F.lit(1)).alias("rows"))
        project(counted, plan).write.mode("overwrite").parquet(f"{output}/rows/batch_id={batch_id}")
        spark = batch.sparkSession
        log = spark.createDataFrame([(observed.get["rows"],)], "rows_read bigint").coalesce(1)
        log.write.mode("overwrite").parquet(f"{output}/log/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def loaded(spark: SparkSession, output: str) -> DataFrame:
    """All rows the micro-batches wrote."""
    return spark.read.parquet(f"{output}/rows").drop("batch_id")


def batch_evidence(spark: SparkSession, output: str) -> DataFrame:
    """Rows read and rows stored per confirmed batch."""
    stored = spark.read.parquet(f"{output}/rows").groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows_written"))
    return spark.read.parquet(f"{output}/log").join(stored, "batch_id", "left").fillna(0, ["rows_written"])
