"""SimHash near-duplicates: bit-sliced comparison of fingerprints that share two of five bit blocks.

Fingerprints that differ in at most three bits agree in two of five blocks, so every such pair meets in one of ten
tables. Inside a table's bucket the bits are stored as vertical planes, 64 fingerprints to a word; one fingerprint
is compared with 64 others at once by adding the differing bits into carry-save counters, and words in which all
counters have passed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelift.llm.text import ROW, map_texts, numbered
from tablelift.session import materialize

#: Differing bits that still link; one less than a power of two, so that a full counter is an overflow.
RADIUS = 3
#: (offset, bits) of the five blocks of a fingerprint.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of a bucket that meet in one task; larger buckets are cut into chunks that meet pair by pair.
CHUNK = 1024
#: Comparisons of a fingerprint with a word of 64 others that are held at once.
PAIRS_AT_ONCE = 400_000

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 (seed 42) of the 3-word shingles; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    if len(words) <= 3:
        hashes = np.array([digest(joined, 42)], np.uint64)
    else:
        starts = [0, *(ends[:-3] + 1).tolist()]
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[2:].tolist(), strict=True)], np.uint64)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """Column ``fp`` (signed long) instead of text; a null text counts as empty."""

    def run(texts: list[bytes]) -> dict:
        return {"fp": pa.array(np.array([fingerprint(text) for text in texts], np.uint64).view(np.int64))}

    return map_texts(documents, run, "fp long")


def close_pairs(values: np.ndarray, group_ends: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of the same group with at most RADIUS differing bits, for i from first to last - 1.

    ``values`` are uint64 fingerprints, ``group_ends`` is the end of each value's group.
    """
    base = first // 64 * 64
    top = int(group_ends[last - 1])
    words = -(-(top - base) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: top - base] = values[base:top]
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    rows = np.arange(first, last)
    begin, end = (rows + 1 - base) // 64, (group_ends[first:last] - 1 - base) // 64 + 1
    spans = np.where(rows + 1 < group_ends[first:last], end - begin, 0)
    query = np.repeat(rows, spans)
    word = np.arange(len(query)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(begin, spans)
    low = np.maximum(query + 1 - base - word * 64, 0).astype(np.uint64)
    high = np.minimum(group_ends[query] - base - word * 64, 64).astype(np.uint64)
    lanes = (_ONES >> (np.uint64(64) - high)) & (_ONES << low)
    counters = [np.zeros(len(query), np.uint64) for _ in range(RADIUS.bit_length())]
    for plane in range(64):
        own = np.uint64(0) - ((values[query] >> np.uint64(plane)) & np.uint64(1))
        carry = planes[plane][word] ^ own
        for place, counter in enumerate(counters):
            counters[place], carry = counter ^ carry, counter & carry
        lanes &= ~carry
        if plane % 4 == 3:
            alive = lanes != 0
            if alive.mean() < 0.75 if len(alive) else False:
                query, word, lanes = query[alive], word[alive], lanes[alive]
                counters = [counter[alive] for counter in counters]
    found = np.flatnonzero(lanes)
    row, lane = np.nonzero(np.unpackbits(lanes[found].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[found[row]], word[found[row]] * 64 + lane + base


def links(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, representative) that join, inside each group of ``sizes`` values, all that is reachable."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    cost = np.cumsum((ends - np.arange(len(values))) // 64 + 1)
    label, first = np.arange(len(values)), 0
    while first < len(values):
        last = int(np.searchsorted(cost, (cost[first - 1] if first else 0) + PAIRS_AT_ONCE)) or 1
        last = min(max(last, first + 1), len(values))
        i, j = close_pairs(values, ends, first, last)
        while len(i):
            low = np.minimum(label[i], label[j])
            before = label.copy()
            for side in (i, j):
                np.minimum.at(label, before[side], low)
                np.minimum.at(label, side, low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        first = last
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _block(place: int):
    offset, bits = BLOCKS[place]
    return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << bits) - 1))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within the radius."""
    tables = [
        F.lit(number << 26).bitwiseOR(F.shiftleft(_block(first), 13)).bitwiseOR(_block(second))
        for number, (first, second) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    entries = distinct.select("fp", F.explode(F.array(*tables)).alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = entries.join(materialize(sizes, "simhash-buckets"), "bucket")
    # A large bucket is dealt into chunks by a hash; every two chunks meet as a group of their own.
    chunks = F.ceil(F.col("size") / F.lit(CHUNK))
    met = shared.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), F.col("own"))
    )
    met = met.select("bucket", "fp", "own", F.explode(others).alias("other"))
    groups = met.groupBy("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    groups = groups.agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            a, b = links(values, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            found = np.unique(np.column_stack((a, b)).view(np.int64), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node that can be reached.

    Large-star and small-star steps take turns until the edges are stars. Minima are aggregated before they are
    joined back from written tables, so that a hub's edges can be split over tasks.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(materialize(lows, "large-low"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large-star")
        lows = materialize(large.groupBy("u").agg(F.min("v").alias("low")), "small-low")
        moved = large.join(lows, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = materialize(moved.unionByName(lows.withColumnRenamed("low", "v")).distinct(), "small-star")
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(sums):
            break
        mark = tuple(sums)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable over links) of every row of ``documents``.

    Texts that are null, empty or without a word have fingerprint zero and link like any other. Equal fingerprints
    are one node, so repeated rows and exact copies cost one comparison. A null doc_id keeps its row, but never
    names a component; a component without any doc_id is null. Extra columns are ignored.
    """
    marked = materialize(fingerprints(documents.select("doc_id", "text")), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = materialize(connected(near_links(distinct)), "simhash-roots")
    members = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left"), "simhash-members")
    members = members.withColumn("root", F.coalesce("root", "fp"))
    least = materialize(members.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-least")
    named = materialize(members.join(least, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``documents`` that name their component: one document of each group of near copies stays.

    doc_id tells documents apart: of repeated rows of one doc_id one stays, and all rows without one are one document.
    Where ids can be null or stand on several texts, use ``without_copies``.
    """
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = kept.withColumnRenamed("doc_id", "_kept")
    chosen = documents.join(kept, documents["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
    return chosen.dropDuplicates(["doc_id"])


def without_copies(documents: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """Exactly one row of each component of near copies: that of the smallest doc_id, one without id if none has any.

    ``find`` names the component_id of each doc_id.
    """
    rows = numbered(documents)
    found = find(rows.select(F.col(ROW).alias("doc_id"), "text"))
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.number").alias("_kept"))
    return rows.join(kept, rows[ROW]["number"] == kept["_kept"], "left_semi").drop(ROW)


def brute_force(texts: dict[int, bytes]) -> dict[int, tuple[str, int]]:
    """doc_id to (fingerprint, component_id) by comparing all pairs; for tests."""
    marks = {doc_id: fingerprint(text) for doc_id, text in texts.items()}
    root = {doc_id: doc_id for doc_id in texts}

    def top(doc_id: int) -> int:
        while root[doc_id] != doc_id:
            doc_id = root[doc_id]
        return doc_id

    for a, b in combinations(sorted(texts), 2):
        if (marks[a] ^ marks[b]).bit_count() <= RADIUS:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {doc_id: (format(marks[doc_id], "016x"), top(doc_id)) for doc_id in texts}
