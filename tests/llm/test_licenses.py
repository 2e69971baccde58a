import re

import pytest

from tablelift.llm import licenses


def plain(text):
    """Base columns by splitting into words and comparing every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        found += [(place, label) for place in range(len(words)) if words[place : place + len(parts)] == parts]
    places = [place for place, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


CASES = [
    "Licensed under the Apache License, Version 2.0.", "MIT LICENSE mit-license; mit  license", "xmit license", "mit licenses",
    "CC BY 4.0, cc-by, CC\nBY", "GNU General Public\tLicense v3 and gnu.general.public.license", "cc bye occ by", "émit license", "", None,
]


@pytest.mark.parametrize("text", CASES)
def test_base_columns(text):
    out = {name: column.to_pylist()[0] for name, column in licenses.scan([(text or "").encode()]).items()}
    assert (out["n_words"], out["n_base"], out["first_word"], out["last_word"], out["base_labels"]) == plain(text)
    assert set(filter(None, out["base_labels"].split(","))) <= set(out["labels"].split(","))


def test_base_columns_of_all_documents(documents, texts):
    for row in licenses.scan_licenses(documents).collect():
        expected = plain(texts[row["doc_id"]].decode())
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == expected


def test_there_are_hundreds_of_rules_and_better_ones_win():
    assert len(licenses.rules()) > 200
    text = b"released under the terms of the gnu general public license, version 3 or spdx-license-identifier: mit"
    assert [(label, confidence) for _, _, label, confidence in licenses.detect(text)] == [("gpl-3.0", 0.99), ("mit", 1.0)]
    assert [label for *_, label, _ in licenses.detect(b"cc by-nc-nd 4.0")] == ["cc-by-nc-nd"]


def test_prefilter_and_name_gate_hide_no_rule():
    texts = [case.encode().lower() for case in CASES if case]
    for text in texts:
        every = []
        for priority, family, _, label, confidence, pattern in licenses.rules():
            every += [(m.start(), m.end(), priority, family, label, confidence) for m in pattern.finditer(text)]
        kept = []
        for item in sorted(every, key=lambda item: (item[2], item[3], item[0] - item[1], item[0])):
            if all(item[1] <= other[0] or other[1] <= item[0] for other in kept):
                kept.append(item)
        assert licenses.detect(text) == sorted((a, b, label, confidence) for a, b, _, _, label, confidence in kept)


def test_many_detections_stay_quick_and_disjoint():
    found = licenses.detect(b"mit license. " * 5000)
    assert len(found) == 5000 and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_odd_rows(odd, empty):
    rows = licenses.scan_licenses(odd).collect()
    by_id = {row["doc_id"]: row for row in rows}
    assert len(rows) == 11 and by_id[1]["n_words"] == 0 and by_id[1]["score"] == 0 and by_id[5]["n_words"] == 60_000
    assert licenses.scan_licenses(empty).count() == 0
