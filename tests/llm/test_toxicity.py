import numpy as np
import pytest

from tablelift.llm import toxicity


def maximal(scores):
    """All maximal scoring segments by their definition: the best segment, then the same on both sides of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            total = sum(scores[a:b])
            if total > 0 and (best is None or (total, -(b - a)) > (best[0], -(best[2] - best[1]))):
                best = (total, a, b)
    if best is None:
        return []
    total, a, b = best
    return maximal(scores[:a]) + [(a, b, total)] + [(x + b, y + b, t) for x, y, t in maximal(scores[b:])]


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_their_definition(seed):
    scores = np.random.default_rng(seed).normal(-0.2, 1, 25).round(3)
    got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
    assert got == [(a, b, round(s, 6)) for a, b, s in maximal(scores.tolist())]
    assert np.isclose(toxicity.best_segment(scores), max([s for *_, s in got], default=0.0))


def test_rate_solves_its_equation():
    scores = [np.array([-0.35] * 99 + [3.0]), np.array([-0.35] * 50)]
    rate = toxicity._rate(scores, np.array([False, False]))
    flat = np.concatenate(scores)
    assert rate > 0 and np.isclose(np.exp(rate * flat).mean(), 1, atol=1e-3)


def sample():
    chooser = np.random.default_rng(2)
    common = [b"w%d" % k for k in range(60)]
    rows = []
    for k in range(300):
        words = list(chooser.choice(common, 80))
        if k % 3 == 0:
            words[20:24] = [b"nasty", b"vile", b"nasty", b"rotten"]
        rows.append((b" ".join(words), int(k % 3 == 0)))
    return rows


def test_toxic_passages_are_found_in_long_texts():
    model = toxicity.fit(sample())
    assert {b"nasty", b"vile", b"rotten"} <= set(model.weights) and len(model.weights) < 10
    clean, toxic = b"w1 w2 w3 " * 5000, b"w1 w2 w3 " * 5000 + b"nasty vile rotten nasty " + b"w4 w5 " * 5000
    out = toxicity.score_texts(model, [clean, toxic, b""], 0.3)
    assert out["predicted"].to_pylist() == [0, 1, 0]
    assert out["segments"].to_pylist()[1][0]["start"] == 15000 and out["segments"].to_pylist()[1][0]["end"] == 15004


@pytest.mark.parametrize("rows", [[], [(b"a", 0)], [(b"a", 1)]])
def test_without_both_labels(rows):
    scores = toxicity.score_texts(toxicity.fit(rows), [b"a b", b""], 0.3)["score"].to_pylist()
    assert len(set(scores)) == 1 and 0 <= scores[0] <= 1


def test_odd_rows(odd, empty):
    model = toxicity.fit(sample())
    rows = toxicity.score_toxicity(odd.select("doc_id", "text"), model).collect()
    assert len(rows) == 11 and all(0 <= row["score"] <= 1 for row in rows)
    assert toxicity.score_toxicity(empty.select("doc_id", "text"), model).count() == 0


def test_held_out_rows(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "toxic AS label")
    model = toxicity.learn(frame, labels.filter("doc_id % 3 <> 0"))
    found = toxicity.score_toxicity(frame, model).join(labels.filter("doc_id % 3 = 0"), "doc_id")
    clean = found.filter("label = 0")
    assert clean.filter("predicted = 0").count() / clean.count() > 0.97
    assert found.filter("label = 1 AND predicted = 1").count() >= 0.5 * found.filter("label = 1").count()


def test_evidence_is_the_best_over_all_segments():
    for mean, n in ((12.0, 40), (0.3, 3), (700.0, 900), (3000.0, 2500), (40.0, 40)):
        tails, term, below = [], np.exp(-mean / 2), 0.0
        for k in range(n):
            below += term * np.exp(-mean / 2)
            tails.append(1 - below)
            term *= mean / (k + 1)
        expected = max(-np.log(max(tail, 1e-300)) for tail in tails)
        got = toxicity._evidence(np.zeros(n), 1, 1.0, mean)
        if mean < 1000 and expected < 20:
            assert np.isclose(got, expected, rtol=1e-4)
        if mean == 3000.0:
            assert got < 1e-9
    assert np.isclose(toxicity._evidence(np.zeros(40), 1, 1.0, 12.0), 22.6, atol=0.1)
    assert toxicity._evidence(np.zeros(8), 1, 1.0, 12.0) < 0.1


def test_many_mild_passages_add_up():
    model = toxicity.fit(sample())
    # A whole word, not the beginning of one (marked by a star); names decide between equal weights.
    word = min((part for part in model.weights if not part.endswith(b"*")), key=lambda part: (model.weights[part], part))
    mean_one = toxicity._evidence(np.array([model.weights[word]]), 1, model.rate, model.constant)
    assert mean_one >= 0
    length = int(12 / (model.constant * np.exp(-model.rate * model.weights[word])))
    gap = b"w1 " * max(30, length // 40)
    mild = (gap + word + b" ") * 40
    alone = (gap + word + b" ") * 8 + gap * 32
    out = toxicity.score_texts(model, [mild, alone], 0.3)["score"].to_pylist()
    assert out[0] > out[1]
