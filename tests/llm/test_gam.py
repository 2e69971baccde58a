import numpy as np
import pytest

from tablelift.llm import gam


def test_interaction_is_learned_by_pairs():
    chooser = np.random.default_rng(0)
    x = chooser.random((4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit_numbers(x[:3000], y[:3000])
    right = ((gam.margins(model, x[3000:]) > 0) == (y[3000:] > 0.5)).mean()
    assert (0, 1) in {(a, b) for a, b, *_ in model.pairs} and right > 0.9


def test_margin_is_the_sum_of_table_entries():
    chooser = np.random.default_rng(1)
    x = chooser.random((500, len(gam.FEATURES)))
    model = gam.fit_numbers(x, (x[:, 2] > 0.6).astype(float))
    for row, margin in zip(x[:20], gam.margins(model, x[:20]), strict=True):
        total = model.intercept
        for value, edge, table in zip(row, model.edges, model.tables, strict=True):
            total += table[sum(value >= cut for cut in edge)]
        for a, b, edge_a, edge_b, grid in model.pairs:
            total += grid[sum(row[a] >= cut for cut in edge_a), sum(row[b] >= cut for cut in edge_b)]
        assert np.isclose(total, margin)


@pytest.mark.parametrize("labels", [[], [1.0, 1.0], [0.0]])
def test_one_label_or_none(labels):
    model = gam.fit_numbers(np.zeros((len(labels), len(gam.FEATURES))), np.array(labels))
    assert np.isfinite(gam.margins(model, np.zeros((2, len(gam.FEATURES))))).all()


def test_features_of_odd_texts():
    for text in (b"", b" \n\t ", b"a", b"x" * 200_000, "é ß 日本".encode(), b"\n\n\n."):
        found = gam.features(text)
        assert len(found) == len(gam.FEATURES) and np.isfinite(found).all()
    assert gam.features(b"") == [0.0] * len(gam.FEATURES)


def test_odd_rows(odd, empty):
    model = gam.fit_sample([(b"a fine text of words", 1), (b"### $$$ ### !!!", 0)] * 30)
    rows = gam.score_quality(odd.select("doc_id", "text"), model).collect()
    assert len(rows) == 11 and all(0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7) for row in rows)
    assert gam.score_quality(empty.select("doc_id", "text"), model).count() == 0


def test_held_out_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality AS label")
    model = gam.learn(frame, labels.filter("doc_id % 3 <> 0"))
    held = labels.filter("doc_id % 3 = 0")
    found = gam.score_quality(frame, model).join(held, "doc_id")
    assert found.filter("predicted = label").count() / held.count() > 0.9


def test_the_commonest_word_counts_wherever_it_stands():
    text = b"first spam spam spam spam middle one two three end"
    assert gam.features(text)[gam.FEATURES.index("top_share")] == 0.4
