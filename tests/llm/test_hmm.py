import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablelift.llm import hmm


def brute(model, ids):
    states, total = len(model.start), 0.0
    for path in itertools.product(range(states), repeat=len(ids)):
        chance = model.start[path[0]] * model.emit[ids[0], path[0]]
        for t in range(1, len(ids)):
            chance *= model.move[path[t - 1], path[t]] * model.emit[ids[t], path[t]]
        total += chance
    return math.log(total)


def small_model(states=3, symbols=5):
    chooser = np.random.default_rng(1)
    return hmm.Hmm(chooser.dirichlet(np.ones(states)), chooser.dirichlet(np.ones(states), states), chooser.dirichlet(np.ones(symbols), states).T)


def test_forward_equals_enumeration_over_paths():
    model = small_model()
    chains = [[0, 1, 4], [2], [3, 3, 0, 1, 2], [1, 1]]
    ids, sizes = np.array(sum(chains, [])), np.array([len(chain) for chain in chains])
    logs, _, _ = hmm.forward(model, ids, sizes)
    assert np.allclose(logs, [brute(model, chain) for chain in chains])


def test_expected_counts_equal_enumeration():
    model = small_model(2, 4)
    chain = [0, 3, 1, 1]
    start, move, emit = hmm.expected(model, np.array(chain), np.array([4]))
    total, starts, moves, emits = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for path in itertools.product(range(2), repeat=4):
        chance = model.start[path[0]] * model.emit[chain[0], path[0]]
        for t in range(1, 4):
            chance *= model.move[path[t - 1], path[t]] * model.emit[chain[t], path[t]]
        total += chance
        starts[path[0]] += chance
        for t in range(4):
            emits[chain[t], path[t]] += chance
            if t:
                moves[path[t - 1], path[t]] += chance
    assert np.allclose(start, starts / total) and np.allclose(move, moves / total) and np.allclose(emit, emits / total)


def test_rounds_never_lower_the_likelihood_of_the_sample():
    texts = [b"a b a b", b"c d c d c", b"a b b a", b"d c d"] * 5
    counts = Counter(w for t in texts for w in t.split())
    lexicon = hmm.Lexicon("t", sorted(counts), np.array([counts[w] for w in sorted(counts)]), np.ones(hmm.CLASSES, np.int64), 100, 5, 20, 1)
    shares = lexicon.shares()
    ids, sizes, _ = hmm.symbols_of(lexicon, texts)
    model = hmm.maximised(np.zeros(2), np.eye(2), np.random.default_rng(0).random((lexicon.symbols, 2)), shares)
    before = hmm.forward(model, ids, sizes)[0].sum()
    for _ in range(5):
        model = hmm.maximised(*hmm.expected(model, ids, sizes), shares * 0.001)
    assert hmm.forward(model, ids, sizes)[0].sum() > before


def check(frame, training, frequent):
    """Base score, counts and total mass against plain counting."""
    counts_frame = hmm.materialize(hmm.count_words(training), "test-counts")
    lexicon = hmm.lexicon(counts_frame, frequent)
    model = hmm.fit(hmm.encode(training, lexicon), lexicon, rounds=1, states=3)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    counts = Counter()
    for row in training.collect():
        counts.update((row["text"] or "").encode().lower().split())
        counts[b""] += 1
    total, distinct = sum(counts.values()), len(counts)
    rows = hmm.score_texts(frame, counts_frame, lexicon, model).collect()
    texts = Counter((row["doc_id"], row["text"]) for row in frame.collect())
    by_id = {doc_id: (text or "").encode().lower().split() + [b""] for doc_id, text in texts}
    assert len(rows) == sum(texts.values())
    for row in rows:
        words = by_id[row["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert row["score"] <= 1e-9
    return lexicon, model, counts


def test_one_encoding_gives_the_same_scores(documents):
    frame = documents.select("doc_id", "text").limit(60)
    both = [hmm.learn_and_score(frame, documents["doc_id"] % 2 == 0), hmm.score_texts(frame, *hmm.learn(frame.filter("doc_id % 2 = 0").select("text")))]
    one, other = ({row["doc_id"]: (row["n_known"], round(row["base_score"], 6), round(row["score"], 6)) for row in found.collect()} for found in both)
    assert one == other


def test_chains_cover_all_symbols(monkeypatch):
    monkeypatch.setattr(hmm, "CHAIN", 4)
    assert hmm._chains([b"\0" * 4 * n for n in (1, 4, 5, 12)]).tolist() == [1, 4, 4, 1, 4, 4, 4] and hmm._chains([]).tolist() == []


def test_copies_lean_alike():
    lexicon = hmm.Lexicon("t", [b"a", b"b"], np.array([2, 2]), np.ones(hmm.CLASSES, np.int64), 6, 2, 2, 1)
    chain = np.array([0, 1, 2 + hmm.CLASSES], np.int32).tobytes()
    _, _, once = hmm.leaning([chain], lexicon, 3)
    _, _, twice = hmm.leaning([chain, chain], lexicon, 3)
    assert np.allclose(2 * once, twice) and np.isclose(once.sum(), 3)


def test_scores_of_odd_rows(odd):
    frame = odd.select("doc_id", "text")
    check(frame, frame.filter("doc_id > 3").select("text"), 3)


def test_without_training_rows(odd, empty):
    check(odd.select("doc_id", "text"), empty.select("text"), 10)


def test_rare_words_share_the_mass_of_their_class(documents):
    frame = documents.select("doc_id", "text").limit(40)
    lexicon, model, counts = check(frame, frame.filter("doc_id % 2 = 0").select("text"), 50)
    assert 0 < len(lexicon.words) <= 50
    inside = Counter()
    for word, count in counts.items():
        if word and word not in lexicon.words:
            inside[hmm.word_class(word)] += (count + 1) / lexicon.class_total[hmm.word_class(word)]
    for place, mass in inside.items():
        assert math.isclose(mass + 1 / lexicon.class_total[place], 1.0)


def test_model_beats_base_on_held_out_texts(documents):
    held = documents.filter("doc_id % 5 = 1").select("doc_id", "text")
    learned = hmm.learn(documents.filter("doc_id % 5 <> 1").select("text"))
    sums = hmm.score_texts(held, *learned).groupBy().sum("score", "base_score").first()
    assert sums[0] > sums[1]


def test_python_gets_small_batches(spark):
    frame = spark.range(0, 1500, 1, 1).selectExpr("repeat('some words ', 1000) AS text")
    counts = {bytes(row["word"]): row["c"] for row in hmm.count_words(frame).collect()}
    assert counts == {b"some": 1_500_000, b"words": 1_500_000, b"": 1500}

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    sizes = [row["n"] for row in frame.mapInArrow(run, "n long").collect()]
    assert max(sizes) < 5_000_000 < sum(sizes)


ODD_TEXTS = [None, "", "  a", "A\x1cb  C\x0bd ", "\u00c9\u00a0x a a\r\nA", " \t\n\x0c", "rare RARE ab abcd \u20ac", "a" * 5000]


def test_words_are_those_of_bytes():
    plain = [(text or "").encode().lower().split() for text in ODD_TEXTS]
    for kind in (pa.string(), pa.large_string()):
        # A slice, as ranges of a batch are.
        words, codes, sizes = hmm.tokens_of(pa.array(["x y", *ODD_TEXTS], kind).slice(1))
        words = words.to_pylist()
        assert [words[code] for code in codes] == sum(plain, []) and sizes.tolist() == [len(one) for one in plain]
    lexicon = hmm.Lexicon("odd-words", [b"a", b"b"], np.array([2, 2]), np.ones(hmm.CLASSES, np.int64), 6, 2, 2, 1)
    ids, sizes, rare = hmm.symbols_of(lexicon, pa.array(ODD_TEXTS))
    number = {b"a": 0, b"b": 1}
    assert ids.tolist() == [x for one in plain for x in (*(number.get(w, 2 + hmm.word_class(w)) for w in one), 2 + hmm.CLASSES)]
    assert sizes.tolist() == [len(one) + 1 for one in plain]
    assert [{w["word"]: w["n"] for w in one} for one in rare.to_pylist()] == [Counter(w for w in one if w not in number) for one in plain]


def test_classes_of_counted_words(spark):
    frame = spark.createDataFrame([(text,) for text in ODD_TEXTS], "text string")
    rows = hmm.count_words(frame).collect()
    plain = Counter(w for text in ODD_TEXTS for w in [*(text or "").encode().lower().split(), b""])
    assert {bytes(row["word"]): row["c"] for row in rows} == plain and len(rows) == len(plain)
    assert all(row["class"] == hmm.word_class(bytes(row["word"])) for row in rows)


def test_ranges_cover_all_rows(monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 5)
    for texts in ([], [None], ["", "abc", "x" * 40, "", "de", None, "fghi", "j"]):
        ranges = list(hmm._ranges(pa.array(texts, pa.string())))
        assert [place for a, b in ranges for place in range(a, b)] == list(range(len(texts)))


@pytest.mark.parametrize("scaled", [1, 3, 8])
def test_scaling_changes_no_result(monkeypatch, scaled):
    """Chains that end before, at and after steps that are scaled, against unscaled steps of one chain at a time."""
    monkeypatch.setattr(hmm, "SCALED", scaled)
    model, chooser = small_model(4, 6), np.random.default_rng(3)
    chains = [chooser.integers(0, 6, size).astype(np.int32) for size in (1, 8, 30, 7, 9, 1, 17, 2, 16)]
    ids, sizes = np.concatenate(chains), np.array([len(chain) for chain in chains])
    logs, starts, moves, emits = [], np.zeros(4), np.zeros((4, 4)), np.zeros((6, 4))
    for chain in chains:
        alpha, beta = [model.start * model.emit[chain[0]]], [np.ones(4)]
        for symbol in chain[1:]:
            alpha.append(alpha[-1] @ model.move * model.emit[symbol])
        for symbol in chain[:0:-1]:
            beta.insert(0, model.move @ (model.emit[symbol] * beta[0]))
        total = alpha[-1].sum()
        logs.append(math.log(total))
        starts += alpha[0] * beta[0] / total
        for t, symbol in enumerate(chain):
            emits[symbol] += alpha[t] * beta[t] / total
            if t:
                moves += np.outer(alpha[t - 1], model.emit[symbol] * beta[t]) * model.move / total
    assert np.allclose(hmm.forward(model, ids, sizes)[0], logs, rtol=1e-12)
    for found, plain in zip(hmm.expected(model, ids, sizes), (starts, moves, emits), strict=True):
        assert np.allclose(found, plain, rtol=1e-10)


def test_long_improbable_chains_stay_finite():
    emit = np.full((2, 3), 1e-30)
    emit[1] = 1.0
    model = hmm.Hmm(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), emit)
    logs, _, _ = hmm.forward(model, np.zeros(5000, np.int32), np.array([5000]))
    assert math.isclose(logs[0], 5000 * math.log(1e-30), rel_tol=1e-9)
    assert all(np.isfinite(part).all() for part in hmm.expected(model, np.zeros(5000, np.int32), np.array([5000])))
