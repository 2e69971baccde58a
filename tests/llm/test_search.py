"""Exact search against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelift.llm import search


def brute_force(rows, k):
    """rows: (id, vector). Results per query row, as sorted lists of (query_id, rank, id, score)."""
    fit = [(id_, [math.floor(256 * x) for x in vector]) for id_, vector in rows if vector is not None and all(x is not None and math.isfinite(x) for x in vector)]
    out = []
    for place, (query, v) in enumerate(fit):
        if query is None or query % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), other is None, other, n) for n, (other, w) in enumerate(fit) if n != place]
        scored.sort(key=lambda one: (one[0], one[1], one[2] or 0))
        out += [(query, rank, other, -score) for rank, (score, _, other, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def search_rows(frame, k=5):
    return sorted(map(tuple, search.top_k(frame, F.col("vec_id") % 50 == 0, k).collect()), key=str)


@pytest.mark.parametrize("blocks", [(1 << 17, 1 << 13, 8192), (40, 3, 7), (64, 64, 16)])
def test_equals_all_products(spark, monkeypatch, blocks):
    monkeypatch.setattr(search, "CANDIDATES", blocks[0])
    monkeypatch.setattr(search, "QUERIES", blocks[1])
    chooser = random.Random(1)
    rows = [(k, [chooser.choice([0.0, 0.0, chooser.uniform(-1, 1)]) for _ in range(12)]) for k in range(240)]
    # A third of all rows are one vector, so that ties decide; some queries among them.
    rows += [(k, [0.5] * 12) for k in range(250, 360)]
    rows += [(400, []), (450, [1.0]), (401, None), (402, [None, 1.0]), (500, [float("nan")] * 12), (550, [float("inf")])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    exact = [(k, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    assert search_rows(frame) == brute_force(exact, 5)


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "score": F.lit("x"), "rank": F.lit(None), "block": F.lit(2)})
    assert search_rows(frame, 10) == brute_force(rows, 10)
    assert search_rows(frame.filter("false")) == [] and search_rows(frame.filter("vec_id = 7")) == []
    assert search_rows(frame.limit(1)) == []


def test_large_numbers(spark):
    rows = [(0, [1e6] * 40), (1, [1e6] * 40), (2, [-1e6] * 40), (3, [1e300, 1.0]), (50, [-1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(query, other): score for query, _, other, score in search_rows(frame)}
    assert found[0, 1] == 256_000_000**2 * 40 if 256_000_000**2 * 40 < 1 << 63 else found[0, 1] == (1 << 63) - 1
    assert found[0, 2] < 0 < found[0, 3] and found[50, 3] == -(1 << 63)


def test_block_keeps_the_first_of_equals():
    values, starts = np.ones(20_000, np.int64), np.arange(20_001)
    query = np.array([2], np.int64), np.array([0, 1])
    _, place, score = search.best_of_block(query, np.array([3]), (values, starts), np.arange(20_000), 5)
    assert place.tolist() == [0, 1, 2, 4, 5] and score.tolist() == [2] * 5
