import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablelift.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(packing.tokenizer_json())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text.decode(), add_special_tokens=False).ids, packing.END_ID]


def check(rows, texts, tokenizer):
    """Every id in one piece, gapless sequences, checksums; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row["doc_id"], []).append(row)
        by_sequence.setdefault(row["sequence_id"], []).append(row)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = ids_of(tokenizer, texts[doc_id]), 0
        for piece in sorted(pieces, key=lambda row: row["start"]):
            assert piece["start"] == at and piece["length"] > 0 and piece["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + piece["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == piece["ids_crc32"]
            at += piece["length"]
        assert at == len(ids)
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for piece in sorted(pieces, key=lambda row: row["offset"]):
            assert piece["offset"] == at
            at += piece["length"]
        assert at <= packing.WINDOW
        total += at
    return 1 - total / (len(by_sequence) * packing.WINDOW)


def test_whole_table(documents, texts, tokenizer):
    assert check(packing.pack(documents, packing.tokenizer_json()).collect(), texts, tokenizer) < 0.05


def test_odd_rows(odd, empty, tokenizer):
    frame = odd.filter("doc_id <> 7").select("*")
    texts = {row["doc_id"]: (row["text"] or "").encode() for row in frame.collect()}
    check(packing.pack(frame, packing.tokenizer_json()).collect(), texts, tokenizer)
    twice = packing.pack(odd.filter("doc_id = 7"), packing.tokenizer_json()).collect()
    assert len(twice) == 2 and sorted(row["offset"] for row in twice) == [0, twice[0]["length"]]
    assert packing.pack(empty, packing.tokenizer_json()).count() == 0


def test_many_equal_lengths_leave_little_padding(spark, tokenizer):
    rows = [(k, "word " * 2999) for k in range(300)] + [(1000 + k, "word " * (50 * k + 7)) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {doc_id: text.encode() for doc_id, text in rows}
    assert check(packing.pack(frame, packing.tokenizer_json()).collect(), texts, tokenizer) < 0.03


def test_cached_words_equal_the_tokenizer(tokenizer, texts):
    tokens = packing.WordTokens(packing.tokenizer_json())
    odd = [
        "It's 3 o'clock, don't!", "ÀÉÎ ßtraße naïve café", "İstanbul ΣΑΣ ﬁne ǅ", "<|endoftext|> a<|startoftext|>b", "a b c\x1cd",
        "###$$$ |x| 10.0.0.1 +1 (555) 123", "", "日本語 テスト ½ ²", "ªº µ × ÷ x×y", "'s 'LL ''re",
    ]
    for text in [*(text.encode() for text in odd), *texts.values()]:
        got = np.frombuffer(tokens.encode([text])[0], "<u4").tolist()
        assert got == tokenizer.encode(text.decode(), add_special_tokens=False).ids, text[:80]


def test_a_full_cache_starts_anew(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHED_BYTES", 1000)
    tokens = packing.WordTokens(packing.tokenizer_json())
    for text in (b"one two three", b"four five six one", b"seven"):
        assert np.frombuffer(tokens.encode([text])[0], "<u4").tolist() == tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_latin_text_is_cut_before_the_tokenizer(tokenizer):
    tokens = packing.WordTokens(packing.tokenizer_json())
    tokens.tokenizer = SimpleNamespace(model=tokenizer.model)
    texts = [b'It\'s "quoted", don\'t <b>99 ml</b>', "ÀÉÎ ßtraße, 'LL ''re \x0b\n x-y".encode(), b"", b" \t"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in tokens.encode(texts)]
    assert got == [tokenizer.encode(text.decode(), add_special_tokens=False).ids for text in texts]


def test_any_mix_of_letters_equals_the_tokenizer(tokenizer):
    chooser, tokens = random.Random(3), packing.WordTokens(packing.tokenizer_json())
    letters = "abSstTLlmdrREev'09 <>|.\"!\n\x1c\x7fÀéß×²\xa0\u0301İK’日"
    texts = ["".join(chooser.choices(letters[: chooser.choice((25, 40))], k=chooser.randrange(25))).encode() for _ in range(1000)]
    for text, ids in zip(texts, tokens.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text.decode(), add_special_tokens=False).ids, text


def test_nnls_is_optimal():
    chooser = np.random.default_rng(0)
    for _ in range(20):
        matrix, target = chooser.random((8, 20)), chooser.normal(size=8)
        x = packing.nnls(matrix, target)
        gain = matrix.T @ (target - matrix @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_combinations_fill_the_window():
    rows = packing.combinations_of(12)
    assert {tuple(r) for r in rows.tolist()} == {
        (a, b, 12 - a - b) for a in range(13) for b in range(13 - a) if a >= b >= 12 - a - b >= 0
    }


@pytest.mark.parametrize("slack", [0, 2, 16])
def test_patterns_use_no_piece_twice(slack):
    chooser = np.random.default_rng(slack)
    histogram = {int(size): int(count) for size, count in zip(range(1, 17), chooser.integers(0, 50, 16), strict=True) if count}
    used = dict.fromkeys(histogram, 0)
    for pattern in packing.solve(histogram, 16, slack):
        total = sum(size * times for size, times in pattern.parts)
        assert 16 - slack <= total <= 16 and pattern.repeats > 0
        for size, times in pattern.parts:
            used[size] += pattern.repeats * times
    assert all(used[size] <= histogram[size] for size in used)
    assert slack < 16 or used == histogram
