import numpy as np

from tablelift.llm import copies, simhash


def made():
    """Groups of texts with spread edits, a chain, texts with a common passage, short and empty ones."""
    chooser, texts = np.random.default_rng(3), []
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(200 + 20 * group)]
        for edits in (0, 1, 3, 5, 9, 14):
            words = list(base)
            for place in chooser.choice(len(words), edits, replace=False):
                words[place] = f"e{chooser.integers(1 << 30)}"
            texts.append(" ".join(words))
    passage = " ".join(f"p{k}" for k in range(100))
    texts += [f"{passage} " + " ".join(f"t{n}x{k}" for k in range(60)) for n in range(10)]
    return texts + ["one two", "One  TWO", "one two three", "", None, " "]


def brute(texts):
    sets, root = [set(copies.shingles((text or "").encode()).tolist()) for text in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            if one == sets[j] or len(one & sets[j]) >= 0.8 * len(one | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in range(len(texts))}


def test_equals_brute_force_also_where_buckets_are_cut(spark, monkeypatch):
    texts = made()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute(texts)
    assert 12 < len(set(expected.values())) < len(texts) - 30
    for chunk in (2048, 2):
        monkeypatch.setattr(copies, "CHUNK", chunk)
        assert {row["doc_id"]: row["component_id"] for row in copies.near_copies(frame).collect()} == expected


def test_edited_copies_go(spark):
    base = [f"w{k}" for k in range(400)]
    edited = [f"x{k}" if k in (50, 150, 250, 350) else word for k, word in enumerate(base)]
    texts = [" ".join(base), " ".join(edited), " ".join(f"other{k}" for k in range(400))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(row["doc_id"] for row in simhash.without_copies(frame, copies.near_copies).collect()) == [0, 2]


def test_odd_rows(odd, empty):
    assert copies.near_copies(empty).count() == 0
    rows = copies.near_copies(odd.selectExpr("struct(doc_id, text) AS doc_id", "text").distinct()).collect()
    assert len(rows) == 10 and len({row["component_id"] for row in rows}) == 8
