"""Ranked search against full scores of all documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelift.llm import ranking


def brute_force(documents, items, k=20):
    counts = [Counter(ranking.terms_of((text or "").encode())) for _, text in documents]
    sizes = [sum(one.values()) for one in counts]
    number, length = sum(n > 0 for n in sizes), sum(sizes)
    holding = Counter(term for one in counts for term in one)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _), one, n in zip(documents, counts, sizes, strict=True):
            score = 0
            for term in ranking.terms_of((text or "").encode()):
                if one[term]:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * holding[term] + 1)))
                    score += w * (10**9 * one[term] // (1000 * one[term] + 12 * (75 + 25 * n * number // length)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def found(documents, items, k=20):
    return sorted(map(tuple, ranking.rank_documents(documents, items, k).collect()), key=str)


@pytest.mark.parametrize(("shard", "part"), [(1 << 20, 8_000_000), (60, 200)])
def test_equals_full_scores(spark, monkeypatch, shard, part):
    monkeypatch.setattr(ranking, "SHARD", shard)
    monkeypatch.setattr(ranking, "PART_BYTES", part)
    chooser = random.Random(4)
    words = [f"w{int(chooser.paretovariate(0.8))}" for _ in range(400)] + ["Élan", "X1", "日本"]
    text = lambda n: chooser.choice([" ", "-", "_", ". "]).join(chooser.choice(words) for _ in range(n))
    documents = [(k, text(chooser.choice([0, 1, 3, 30, 200]))) for k in range(150)]
    # Copies: a third of all documents score alike.
    documents += [(k, "w1 w2 élan x1 ELAN") for k in range(1000, 1080)] + [(None, "w1 w2"), (5, "w1 w2"), (200, None)]
    items = [(k, text(12)) for k in range(12)] + [(3, "w1 w1 w2"), (None, "w2"), (77, ""), (78, None), (79, "never seen")]
    frame = spark.createDataFrame(documents, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("t"), "score": F.lit(0)})
    assert found(frame.repartition(7), spark.createDataFrame(items, "item_id long, text string")) == brute_force(documents, items)


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([("a", "the cat"), ("b", None)], "item_id string, text string").withColumn("rank", F.lit(1))
    assert found(empty, items) == [] and found(odd, items.filter("false")) == []
    assert found(empty.unionByName(odd.filter("doc_id <= 3")), items) == []
    rows = [(row["doc_id"], row["text"]) for row in odd.collect()]
    assert found(odd, items, 3) == brute_force(rows, [("a", "the cat")], 3)


def test_stops_before_the_end_and_never_with_a_tie_unseen():
    # Ten documents hold both terms with falling impacts; a thousand hold one of them with less.
    rows = [([0, 1], [1000 - k, 1000 - k]) for k in range(10)] + [([k % 2], [400]) for k in range(1000)]
    offsets = np.cumsum([0, *(len(terms) for terms, _ in rows)])
    terms, impacts = (np.array([x for row in rows for x in row[side]], np.int64) for side in (0, 1))
    shard = ranking.Shard(offsets, terms, impacts, 2)
    documents, scores = shard.best({0: 1, 1: 2}, 3)
    assert documents.tolist() == [0, 1, 2] and scores.tolist() == [3000, 2997, 2994] and shard.seen_positions < 100
    # The eleventh best is one of a thousand equals, of which the smallest documents win.
    documents, scores = shard.best({0: 1}, 15)
    assert documents.tolist() == [*range(10), 10, 12, 14, 16, 18] and scores[-1] == 400


def test_bound_is_no_weaker_than_that_of_last_positions():
    chooser = np.random.default_rng(2)
    dense = chooser.integers(0, 50, (300, 4)) * (chooser.random((300, 4)) < 0.6)
    offsets = np.concatenate(([0], np.cumsum((dense > 0).sum(axis=1))))
    shard = ranking.Shard(offsets, np.nonzero(dense)[1], dense[dense > 0].astype(np.int64), 4)
    for weights in ({0: 1, 1: 1, 2: 1, 3: 1}, {0: 3, 2: 1}, {1: 1}):
        total = sum(count * dense[:, term] for term, count in weights.items())
        order = np.lexsort((np.arange(300), -total))[:20]
        documents, scores = shard.best(weights, 20)
        assert documents.tolist() == order[total[order] > 0].tolist() and scores.tolist() == total[documents].tolist()
