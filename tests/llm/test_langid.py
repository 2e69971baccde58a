import numpy as np
import pytest

from tablelift.llm import langid

SAMPLE = [(b"the cat and the dog of this house with that", "en"), (b"der hund und die katze ist nicht mit dem", "de")] * 20


@pytest.fixture(scope="module")
def model():
    return langid.fit(SAMPLE)


def test_posteriors_equal_enumeration(model):
    letters, heads, counts = langid.words_of([b"the und cat", b"dem of"])
    assert counts.tolist() == [3, 2]
    scores = langid.emissions(model, letters, heads)
    found, pairs = langid.posteriors(model, scores, counts)
    expected_pairs = np.zeros((2, 2))
    for start, size in ((0, 3), (3, 2)):
        total, by_word = 0.0, np.zeros((size, 2))
        paths = np.array(np.meshgrid(*[[0, 1]] * size, indexing="ij")).reshape(size, -1).T
        weights = []
        for path in paths:
            value = model.start[path[0]] + sum(scores[start + t, label] for t, label in enumerate(path))
            value += sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False))
            weights.append(np.exp(value))
        total = sum(weights)
        for path, weight in zip(paths, weights, strict=True):
            for t, label in enumerate(path):
                by_word[t, label] += weight / total
            for a, b in zip(path, path[1:], strict=False):
                expected_pairs[a, b] += weight / total
        assert np.allclose(found[start : start + size], by_word, atol=1e-5)
    assert np.allclose(pairs, expected_pairs, atol=1e-5)


def test_switched_text_is_labelled_word_by_word(model):
    out = langid.label_texts(model, [b"the cat and the dog der hund und die katze", b"the cat", b"!!", b""])
    assert out["n_switches"].to_pylist()[0] == 1
    assert out["lang_pred"].to_pylist() == ["de", "en", "und", "und"] or out["lang_pred"].to_pylist()[1:] == ["en", "und", "und"]


def test_chains_do_not_change_short_texts(model, monkeypatch):
    text = [b" ".join([b"the", b"cat", b"und"] * 40)]
    whole = langid.label_texts(model, text)["score"].to_pylist()[0]
    monkeypatch.setattr(langid, "CHAIN", 60)
    assert abs(langid.label_texts(model, text)["score"].to_pylist()[0] - whole) < 0.05


def test_words_of_counts_by_text_when_texts_hold_line_breaks():
    texts = [b"a b\nc", b"", b"\n", "É Ü".encode(), b"d"]
    assert langid.words_of(texts)[2].tolist() == [3, 0, 0, 2, 1]


def test_odd_rows(model, odd, empty):
    rows = langid.identify_language(odd.select("doc_id", "text", "lang"), model).collect()
    assert len(rows) == 11
    by_id = {row["doc_id"]: row for row in rows}
    assert {by_id[k]["lang_pred"] for k in (1, 2, 3, 8)} == {"und"} and by_id[5]["lang_pred"] == "en"
    assert all(0 <= row["score"] <= 1 for row in rows)
    assert langid.identify_language(empty.select("doc_id", "text"), model).count() == 0


def test_nothing_learned_is_und(spark):
    model = langid.fit([])
    frame = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert langid.identify_language(frame, model).first()["lang_pred"] == "und"


def test_held_out_accuracy(documents):
    train = documents.filter("doc_id % 2 = 0").selectExpr("doc_id", "lang AS label")
    model = langid.learn(documents, train)
    found = langid.identify_language(documents.filter("doc_id % 2 = 1").select("doc_id", "lang", "text"), model)
    assert found.filter("lang = lang_pred").count() / found.count() > 0.95
