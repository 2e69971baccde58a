import numpy as np
import pytest

from tablelift.llm import simhash


def random_near(seed, groups, each, flips):
    chooser = np.random.default_rng(seed)
    out = []
    for base in chooser.integers(0, 1 << 63, groups, dtype=np.uint64):
        for _ in range(each):
            value = base
            for bit in chooser.choice(64, chooser.integers(0, flips + 1), replace=False):
                value ^= np.uint64(1) << np.uint64(bit)
            out.append(value)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("sizes", [[1], [2], [64], [65], [3, 200, 1, 70], [1] * 130 + [5]])
def test_close_pairs_equal_all_pairs(sizes, monkeypatch):
    values = np.concatenate([random_near(k, max(1, size // 4), 4, 5)[:size] for k, size in enumerate(sizes)])
    sizes = np.array([min(size, len(random_near(k, max(1, size // 4), 4, 5)[:size])) for k, size in enumerate(sizes)])
    ends = np.repeat(np.cumsum(sizes), sizes)
    i, j = simhash.close_pairs(values, ends, 0, len(values))
    plain = {(a, b) for a in range(len(values)) for b in range(a + 1, int(ends[a])) if int(values[a] ^ values[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == plain
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 3)
    a, b = simhash.links(values, sizes)
    assert components(values, plain, values) == components(values, zip(a.tolist(), b.tolist(), strict=True), None)


def components(values, pairs, by_place):
    root = {int(v): int(v) for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = sorted((top(int(by_place[a] if by_place is not None else a)), top(int(by_place[b] if by_place is not None else b))))
        root[y] = x
    return {v: top(v) for v in root}


def test_equals_brute_force_on_documents(documents, texts):
    got = {row["doc_id"]: (row["fingerprint"], row["component_id"]) for row in simhash.near_duplicates(documents).collect()}
    assert got == simhash.brute_force(texts)


def test_large_buckets_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    values = random_near(5, 2, 150, 3)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = simhash.near_links(frame)
    found = {row["node"]: row["root"] for row in simhash.connected(links).collect()}
    signed = values.view(np.int64)
    plain = [(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 3]
    root = components(signed, plain, signed)
    sizes = {v for v in root if list(root.values()).count(root[v]) > 1}
    assert set(found) == sizes and all(found[v] == root[v] for v in sizes)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    found = {row["node"]: row["root"] for row in simhash.connected(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    by_id = {row["doc_id"]: row for row in rows}
    assert len(rows) == 11 and {by_id[k]["component_id"] for k in (1, 2, 3)} == {1}
    assert by_id[1]["fingerprint"] == "0" * 16 and by_id[None]["component_id"] is None
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd, simhash.near_duplicates(odd))
    assert sorted(str(row["doc_id"]) for row in kept.collect()) == sorted(map(str, {v["component_id"] for v in rows}))
    assert kept.columns == odd.columns


def test_one_row_of_each_component_whatever_the_ids(spark):
    texts = [" ".join(f"{word}{k}" for k in range(30)) for word in "abcdefg"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[4]), (7, texts[5])]
    frame = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, score string").repartition(3)
    kept = simhash.without_copies(frame)
    expected = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[5])]
    assert sorted(map(str, ((row["doc_id"], row["text"]) for row in kept.collect()))) == sorted(map(str, expected))
    assert kept.columns == frame.columns
