"""Near copies by exact similarity: sets of five-word shingles, MinHash bands for candidates, Jaccard 0.8 or more.

Texts that share one of BANDS bands of ROWS minima meet and are compared by their whole sets. Two texts at the least
similarity miss each other in all bands in (1 - 0.8 ** 5) ** 20, about 4 of 10,000 cases; more similar ones in fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelift.llm.simhash import connected
from tablelift.llm.text import map_texts
from tablelift.session import materialize

#: Words of a shingle, least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of a text, and minima of a band.
BANDS, ROWS = 20, 5
#: Texts, and shingles, of a bucket that meet in one task; larger buckets are cut into chunks that meet pair by pair.
CHUNK, CHUNK_SHINGLES = 2048, 1_000_000
#: Shingles of a text whose minima are taken at once.
AT_ONCE = 4096

_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; fewer words than a shingle's are one, none are none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    last = min(SHINGLE, len(words)) - 1
    starts = [0, *(ends[: len(words) - last - 1] + 1).tolist()]
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[last:].tolist(), strict=True)], np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """A bucket of each band of a set of shingles; none for no shingles."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for first in range(0, len(own), AT_ONCE):
        least = np.minimum(least, (own[first : first + AT_ONCE, None] * _FACTORS[0]).min(axis=0))
    mixed = (least ^ (least >> np.uint64(29))) * _FACTORS[1]
    return mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketches(texts: list[bytes]) -> dict:
    sets = [shingles(text) for text in texts]
    return {
        "node": pa.array([xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) for own in sets], pa.int64()),
        "n": pa.array([len(own) for own in sets], pa.int64()),
        "bands": pa.array([bands(own) for own in sets], pa.list_(pa.int64())),
    }


def _sets(texts: list[bytes]) -> dict:
    return {"own": pa.array([shingles(text).view(np.int64) for text in texts], pa.list_(pa.int64()))}


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places with the least similarity or more that connect all that such pairs connect."""
    sizes = np.array([len(own) for own in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    label, places, found = np.arange(len(sets)), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        apart = (places > i) & (label != label[i])
        if not apart.any():
            continue
        mine = np.zeros(int(flat.max()) + 1, np.int64)
        mine[flat[starts[i] : starts[i] + sizes[i]]] = 1
        both = np.add.reduceat(mine[flat], starts)
        near = apart & (both >= SIMILARITY * (sizes + sizes[i] - both) - 1e-9)
        found += [(i, j) for j in np.flatnonzero(near).tolist()]
        label[np.isin(label, label[near])] = label[i]
    return found


def _links(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that meet in a group and are similar."""
    members = groups.select("group", F.explode("nodes").alias("node")).join(sets, "node")
    met = members.groupBy("group").agg(F.collect_list(F.struct("node", "own")).alias("members")).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for one in batch.column(0):
                nodes = one.values.field("node").to_numpy()
                lists = one.values.field("own")
                owns = [lists[k].values.to_numpy() for k in range(len(lists))]
                for i, j in similar(owns):
                    a.append(int(nodes[i]))
                    b.append(int(nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over near copies) of every row; doc_ids are unique.

    Texts of the same shingles are one node. Null, empty and wordless texts have none and are copies of each other.
    """
    marked = materialize(map_texts(documents.select("doc_id", "text"), _sketches, "node long, n long, bands array<long>"), "copies")
    distinct = marked.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    distinct = materialize(distinct, "copies-distinct")
    entries = distinct.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).filter("size > 1")
    shared = entries.join(materialize(sizes, "copies-buckets"), "bucket")
    # A large bucket is dealt into chunks by a hash; every two chunks meet as a group of their own.
    chunks = F.greatest(F.ceil(F.col("size") / F.lit(CHUNK)), F.least("size", F.ceil(F.col("weight") / F.lit(CHUNK_SHINGLES))))
    met = shared.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), F.col("own"))
    )
    met = met.select("bucket", "node", "own", F.explode(others).alias("other"))
    groups = met.groupBy("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    groups = groups.agg(F.array_sort(F.collect_list("node")).alias("nodes")).filter(F.size("nodes") > 1)
    # Texts that meet in several bands are compared once.
    groups = materialize(groups.select(F.xxhash64("nodes").alias("group"), "nodes").dropDuplicates(["group"]), "copies-groups")
    wanted = distinct.join(groups.select(F.explode("nodes").alias("node")).distinct(), "node").select("node", F.col("rep").alias("doc_id"))
    sets = materialize(map_texts(documents.select("doc_id", "text").join(wanted, "doc_id").select("node", "text"), _sets, "own array<long>"), "copies-sets")
    roots = materialize(connected(_links(sets, groups)), "copies-roots")
    members = distinct.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = materialize(members, "copies-members")
    least = materialize(members.groupBy("root").agg(F.min("rep").alias("component_id")), "copies-least")
    return marked.select("doc_id", "node").join(members.join(least, "root").select("node", "component_id"), "node").drop("node")
