"""Runs against a search over all periods, and the digests against plain code."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tablelift.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute_force(words):
    """(start, length, period) of all runs: for every period the stretches of equal words at that distance."""
    index, found = {}, {}
    numbers = np.array([index.setdefault(word, len(index)) for word in words], np.int64)
    for period in range(1, len(words) // 4 + 1):
        same = np.concatenate(([False], numbers[period:] == numbers[:-period], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = end + period - start
            if length >= max(6, 4 * period):
                found.setdefault((start, length), period)
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    dropped = {k for start, length, period in runs for k in range(start + period, start + length)}
    return [word for k, word in enumerate(words) if k not in dropped]


def planted(doc_id, words):
    hash_, n = zlib.crc32(str(doc_id).encode()), len(words)
    if hash_ % 10 or not n:
        return words
    g = hash_ // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def expected(doc_id, words):
    runs = brute_force(words)
    best = max(runs, key=lambda run: (Fraction(run[1], run[2]), -run[0], -run[2]), default=None)
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    hashes = [hashlib.sha256(one).hexdigest() for one in (lines.encode(), b" ".join(collapsed(words, runs)))]
    return (doc_id, len(runs), *head, *hashes)


def words_of(chooser, kind, size):
    if kind == "two":
        return [chooser.choice("ab") for _ in range(size)]
    if kind == "whole":
        return ([chooser.choice("abcd") for _ in range(chooser.randint(1, 70))] * (size + 1))[:size]
    if kind == "fibonacci":
        a, b = "a", "ab"
        while len(b) <= size:
            a, b = b, b + a
        return list(b[:size])
    out = []
    while len(out) < size:
        unit = [chooser.choice("ab") for _ in range(chooser.randint(1, 4))] * chooser.randint(1, 6)
        out += (unit + [chooser.choice("abc") for _ in range(chooser.randint(0, 40))]) * chooser.randint(1, 7)
    return out[:size]


@pytest.mark.parametrize("kind", ["two", "whole", "fibonacci", "nested"])
def test_runs_equal_all_periods(kind):
    chooser = random.Random(kind)
    for _ in range(60):
        lists = [words_of(chooser, kind, chooser.choice([0, 1, 5, 6, 40, 300, 1500])) for _ in range(chooser.randint(1, 5))]
        found, kept, sizes = periodic._batch([" ".join(words).encode() for words in lists])
        assert found == [brute_force(words) for words in lists] and sizes == [len(words) for words in lists]
        assert [one.decode().split() for one in kept] == [collapsed(words, runs) for words, runs in zip(lists, found, strict=True)]


def test_scales_alone_find_all_larger_periods():
    chooser = random.Random(3)
    for period in [*range(8, 40), 63, 64, 65, 127, 128, 200]:
        unit = [chooser.choice("abc") for _ in range(period)]
        words = ["x"] * chooser.randint(0, 9) + unit * 4 + ["y"] * 9
        assert periodic._batch([" ".join(words).encode()])[0][0] == brute_force(words)


def test_colliding_hashes_are_done_again(monkeypatch):
    plain, calls = periodic._mixed, []

    def poor(x):
        calls.append(1)
        return plain(x) % np.uint64(3) if len(calls) < 5 else plain(x)

    chooser = random.Random(9)
    words = [f"w{chooser.randint(0, 400)}" for _ in range(3000)] + [f"u{k}" for k in range(30)] * 5
    monkeypatch.setattr(periodic, "_mixed", poor)
    assert periodic._batch([" ".join(words).encode()])[0][0] == brute_force(words)


def test_query_equals_plain_code(spark, texts):
    got = {row["doc_id"]: tuple(row) for row in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert got == {doc_id: expected(doc_id, planted(doc_id, text.split())) for doc_id, text in texts.items()}
    assert sum(row[1] > 0 for row in got.values()) > 10


def test_odd_rows(odd, empty):
    rows = periodic.find_runs(odd).collect()
    by_id = {row["doc_id"]: row for row in rows}
    assert len(rows) == 11 and periodic.find_runs(empty).count() == 0
    assert all((by_id[k]["n_words"], by_id[k]["runs"], by_id[k]["collapsed"]) == (0, [], "") for k in (1, 2, 3))
    assert [tuple(run) for run in by_id[5]["runs"]] == [(0, 60_000, 3)] and by_id[5]["collapsed"] == "the same words"
    assert by_id[9]["collapsed"] == "é ß ñ € 　 ｗｉｄｅ" and by_id[None]["collapsed"] == "no id here at all"
    assert periodic.digest(periodic.find_runs(periodic.with_planted_runs(odd))).count() == 11
