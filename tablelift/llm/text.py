"""Shared steps of the text operators: reading, held-out rows, bounded training samples, batches of whole texts.

Texts are handed to Python as UTF-8 bytes. ``bytes.split`` and ``bytes.lower`` know ASCII only, which is what
the word rules of the operators ask for, and no text is ever shortened.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelift.session import materialize

#: Bytes of text that a Python task works on at once. A longer text is a batch of its own.
BATCH_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Column with the key that a stage gives its rows.
ROW = "_row"


def numbered(frame: DataFrame) -> DataFrame:
    """``frame`` written once with a key of its own for each row in ROW, whatever its ids: null, or on many rows.

    Keys are ordered by doc_id, rows without one come last.
    """
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("number"))
    return materialize(frame.withColumn(ROW, key), "numbered")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """CRC32 of the id's text modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_ids(labelled: DataFrame, label: str, rows: int) -> DataFrame:
    """About ``rows`` rows of every label value, chosen by a hash of doc_id, for fitting a classifier.

    The share kept of a label is ``rows`` by its count, so the sample does not grow with the table.
    """
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(F.broadcast(counts), label).filter(draw < F.lit(float(rows)) / F.col("_n")).drop("_n")


def sampled_texts(documents: DataFrame, labelled: DataFrame, label: str, rows: int, longest: int) -> list[tuple]:
    """(text bytes, label) of the bounded sample, sorted so that every run fits the same model.

    ``labelled`` (doc_id, label) is cut to ``rows`` rows per label before it meets the texts. Texts of more than
    ``longest`` characters stay out of the sample; it bounds the driver's memory to rows * longest per label.
    """
    chosen = F.broadcast(bounded_ids(labelled, label, rows).dropDuplicates(["doc_id"]))
    found = documents.select("doc_id", "text").join(chosen, "doc_id").filter(F.length("text") <= longest)
    # An id that many rows repeat is one row of the sample.
    found = found.dropDuplicates(["doc_id"])
    rows_ = [(row["text"].encode(), row[label]) for row in found.select("text", label).toLocalIterator()]
    return sorted(rows_, key=lambda row: (str(row[1]), row[0]))


#: What a Python worker keeps from one task to the next: one thing at a time, for the operator that runs.
_held: dict = {}


def held(key: object, build: Callable[[], object]) -> object:
    """The thing kept under ``key``, built anew if another operator ran in between."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def give_back() -> None:
    """Return memory that is no longer used to the system; a worker lives on and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release() -> None:
    """Let go of what another operator kept in this worker."""
    if _held:
        _held.clear()
        give_back()


def blocks(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes."""
    start = size = 0
    for place, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, place
            start, size = place, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python can import it."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix=f"{root.name}-")
    archive = shutil.make_archive(os.path.join(folder, root.name), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


def map_texts(frame: DataFrame, function: Callable[[list[bytes]], dict], schema: str, text: str = "text") -> DataFrame:
    """Add to each row what ``function`` finds in its text; ``schema`` names and types the new columns in order.

    ``frame`` holds the text column, which is dropped, and whatever the result keeps. Rows stay where they are.
    """
    ship_package(frame.sparkSession)
    kept = [name for name in frame.columns if name != text]
    head = ", ".join(f"`{name}` {frame.schema[name].dataType.simpleString()}" for name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from worked_off(batches)
        give_back()

    def worked_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
            for start, end in blocks(texts):
                part = batch.slice(start, end - start)
                found = function(texts[start:end])
                columns = [part.column(part.schema.get_field_index(name)) for name in kept]
                columns += [value if isinstance(value, pa.Array) else pa.array(value) for value in found.values()]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *found])

    return frame.mapInArrow(run, f"{head}, {schema}" if head else schema)
