"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelift.llm.text import map_texts

#: Base phrases of the scan and their labels (fixed values).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EDGE_LEFT = r"(?<![0-9a-z\x80-\xff])"
_EDGE_RIGHT = r"(?![0-9a-z\x80-\xff])"

#: Families: label, keyword every rule of the family needs, spellings of the name, SPDX identifiers.
#: "_" stands for any run of separators, "V" for an optional version part.
FAMILIES = (
    ("agpl-3.0", "affero", (r"(?:gnu _)?affero general public licen[sc]e",), ("agpl-3.0(?:-only|-or-later)?",)),
    ("lgpl", "lesser", (r"(?:gnu _)?lesser general public licen[sc]e",), (r"lgpl-[23]\.[01](?:-only|-or-later)?",)),
    ("lgpl", "library", (r"gnu library general public licen[sc]e",), ()),
    ("gpl-3.0", "general", (r"gnu general public licen[sc]e,? v(?:ersion)?_?3",), (r"gpl-3\.0(?:-only|-or-later|\+)?",)),
    ("gpl-2.0", "general", (r"gnu general public licen[sc]e,? v(?:ersion)?_?2",), (r"gpl-2\.0(?:-only|-or-later|\+)?",)),
    ("gpl", "general", (r"gnu general public licen[sc]e", r"gnu gpl"), ()),
    ("gfdl", "documentation", (r"gnu free documentation licen[sc]e",), (r"gfdl-1\.[123](?:-only|-or-later)?",)),
    ("apache-2.0", "apache", (r"apache licen[sc]e,? v(?:ersion)?_?2(?:\.0)?", r"apache 2\.0"), (r"apache-2\.0",)),
    ("apache-1.1", "apache", (r"apache (?:software )?licen[sc]e,? v(?:ersion)?_?1\.1",), (r"apache-1\.1",)),
    ("apache", "apache", (r"apache (?:software )?licen[sc]e",), ()),
    ("mit", "mit", (r"mit licen[sc]e", r"mit(?: |/)x11 licen[sc]e"), ("mit", "mit-0")),
    ("mit", "permission", (r"permission is hereby granted,? free of charge,? to any person obtaining a copy",), ()),
    ("bsd-3-clause", "bsd", (r"(?:3|three)(?:-| )clause bsd", r"bsd(?:-| )(?:3|three)(?:-| )clause", r"new bsd licen[sc]e"), ("bsd-3-clause",)),
    ("bsd-2-clause", "bsd", (r"(?:2|two)(?:-| )clause bsd", r"bsd(?:-| )(?:2|two)(?:-| )clause", r"simplified bsd licen[sc]e"), ("bsd-2-clause",)),
    ("bsd", "bsd", (r"bsd(?:-| )style licen[sc]e", r"bsd licen[sc]e"), ("0bsd", "bsd-4-clause")),
    ("bsd", "redistribution", (r"redistribution and use in source and binary forms",), ()),
    ("isc", "isc", (r"isc licen[sc]e",), ("isc",)),
    ("mpl-2.0", "mozilla", (r"mozilla public licen[sc]e,? v?(?:ersion)?_?2\.0", r"mozilla public licen[sc]e"), ("mpl-2.0",)),
    ("epl", "eclipse", (r"eclipse public licen[sc]e",), (r"epl-[12]\.0",)),
    ("eupl", "european", (r"european union public licen[sc]e",), (r"eupl-1\.[12]",)),
    ("cddl", "distribution", (r"common development and distribution licen[sc]e",), (r"cddl-1\.[01]",)),
    ("artistic", "artistic", (r"artistic licen[sc]e",), (r"artistic-[12]\.0",)),
    ("boost", "boost", (r"boost software licen[sc]e",), (r"bsl-1\.0",)),
    ("unlicense", "unlicense", (r"(?:the )?unlicense",), ("unlicense",)),
    ("wtfpl", "fuck", (r"do what the fuck you want to public licen[sc]e",), ("wtfpl",)),
    ("zlib", "zlib", (r"zlib(?:/libpng)? licen[sc]e",), ("zlib",)),
    ("postgresql", "postgresql", (r"postgresql licen[sc]e",), ("postgresql",)),
    ("python", "python", (r"python software foundation licen[sc]e",), (r"psf-2\.0", r"python-2\.0")),
    ("ofl", "font", (r"(?:sil )?open font licen[sc]e",), (r"ofl-1\.1",)),
    ("odbl", "database", (r"open (?:data commons open )?database licen[sc]e",), (r"odbl-1\.0",)),
    ("public-domain", "domain", (r"(?:dedicated to|released into|in) the public domain",), ()),
    ("cc0", "cc0", (r"cc0(?: 1\.0)?",), (r"cc0-1\.0",)),
    ("cc-by-nc-nd", "cc", (r"cc(?:-| )by-nc-nd(?: [1-4]\.0)?",), (r"cc-by-nc-nd-[1-4]\.0",)),
    ("cc-by-nc-sa", "cc", (r"cc(?:-| )by-nc-sa(?: [1-4]\.0)?",), (r"cc-by-nc-sa-[1-4]\.0",)),
    ("cc-by-nc", "cc", (r"cc(?:-| )by-nc(?: [1-4]\.0)?",), (r"cc-by-nc-[1-4]\.0",)),
    ("cc-by-nd", "cc", (r"cc(?:-| )by-nd(?: [1-4]\.0)?",), (r"cc-by-nd-[1-4]\.0",)),
    ("cc-by-sa", "cc", (r"cc(?:-| )by-sa(?: [1-4]\.0)?",), (r"cc-by-sa-[1-4]\.0",)),
    ("cc-by", "cc", (r"cc(?:-| )by(?: [1-4]\.0)?",), (r"cc-by-[1-4]\.0",)),
    ("cc", "commons", (r"creative commons(?: attribution[-a-z]*)?(?: [1-4]\.0)?",), ()),
    ("proprietary", "reserved", (r"all rights reserved",), ()),
    ("proprietary", "proprietary", (r"proprietary and confidential",), ()),
)

#: Phrasings around a name, from the strongest statement to the bare name, with their confidence (fixed values).
TEMPLATES = (
    (r"(?:is |are )?(?:licen[sc]ed|released|distributed|published|made available) under (?:the )?(?:terms of )?(?:the )?{name}", 0.99),
    (r"subject to (?:the )?(?:terms of )?(?:the )?{name}", 0.95),
    (r"licen[sc]e ?[:=] ?(?:the )?{name}", 0.95),
    (r"under (?:the )?(?:terms of )?(?:the )?{name}", 0.9),
    (r"see (?:the )?{name}", 0.7),
    (r"{name}", 0.6),
)


@lru_cache(maxsize=1)
def rules() -> tuple:
    """(priority, keyword, label, confidence, pattern): every family in every phrasing, SPDX tags first."""
    found = []
    for place, (label, keyword, names, tags) in enumerate(FAMILIES):
        for tag in tags:
            pattern = r"spdx-licen[sc]e-identifier: ?" + tag + r"(?![0-9a-z.+-])"
            found.append((0, place, "spdx", label, 1.0, pattern))
        for strength, (template, confidence) in enumerate(TEMPLATES, 1):
            for name in names:
                found.append((strength, place, keyword, label, confidence, template.format(name=name)))
    found.sort(key=lambda rule: rule[:2])
    return tuple(
        (priority, place, keyword, label, confidence, re.compile(_spaced(pattern)))
        for priority, place, keyword, label, confidence, pattern in found
    )


def _spaced(pattern: str) -> bytes:
    """A rule's blanks match any run of white space, "_" any separators or none; whole words only."""
    body = pattern.replace(" ?", r"[\x20\x09-\x0D]*").replace(" ", r"[\x20\x09-\x0D]+").replace("_", r"[\x20\x09-\x0D]*")
    return (_EDGE_LEFT + body + _EDGE_RIGHT).encode("latin-1")


@lru_cache(maxsize=1)
def _names() -> tuple:
    return tuple(tuple(re.compile(_spaced(name)) for name in names) for _, _, names, _ in FAMILIES)


@lru_cache(maxsize=1)
def _prefilter() -> tuple:
    automaton, by_word = ahocorasick.Automaton(), {}
    for place, rule in enumerate(rules()):
        by_word.setdefault(rule[2], []).append(place)
    for word in by_word:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton, by_word


@lru_cache(maxsize=1)
def _base() -> tuple:
    return tuple(
        (label, re.compile((_EDGE_LEFT + _GAP.join(phrase.split()) + _EDGE_RIGHT).encode("latin-1")))
        for phrase, label in sorted(BASE_PHRASES.items())
    )


def detect(text: bytes) -> list[tuple[int, int, str, float]]:
    """Detections (start, end, label, confidence) of a lower-cased text, in order of place.

    Rules run only where their keyword occurs. A detection inside one of an equal or better priority goes, and of
    detections that cross, the one of the better rule stays, the longer one where rules tie.
    """
    automaton, by_word = _prefilter()
    words = {word for _, word in automaton.iter(text.decode("latin-1"))}
    if not words:
        return []
    known, found, named = rules(), [], {}
    for place in sorted(place for word in words for place in by_word[word]):
        priority, family, _, label, confidence, pattern = known[place]
        # Every phrasing but a tag holds the family's name: without the name nothing else of it is tried.
        if priority and family not in named:
            named[family] = any(bare.search(text) for bare in _names()[family])
        if not priority or named[family]:
            found += [(m.start(), m.end(), priority, family, label, confidence) for m in pattern.finditer(text)]
    kept: list[tuple] = []
    for item in sorted(found, key=lambda item: (item[2], item[3], item[0] - item[1], item[0])):
        # What is kept never overlaps, so only the neighbours can.
        place = bisect_left(kept, (item[0],))
        if not (place and kept[place - 1][1] > item[0] or place < len(kept) and kept[place][0] < item[1]):
            kept.insert(place, item)
    return [(start, end, label, confidence) for start, end, _, _, label, confidence in kept]


#: Byte classes of the word rule.
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _word_starts(text: bytes) -> np.ndarray:
    inside = _IS_WORD[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))


def scan(texts: list[bytes]) -> dict:
    out = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
    for raw in texts:
        text = raw.lower()
        starts = _word_starts(text)
        base = [(m.start(), label) for label, pattern in _base() for m in pattern.finditer(text)] if b"licen" in text or b"cc" in text else []
        more = detect(text)
        places = np.searchsorted(starts, [start for start, _ in base]) if base else []
        labels = {label for _, label in base}
        out["n_words"].append(len(starts))
        out["n_base"].append(len(base))
        out["first_word"].append(int(min(places)) if base else None)
        out["last_word"].append(int(max(places)) if base else None)
        out["base_labels"].append(",".join(sorted(labels)))
        out["labels"].append(",".join(sorted(labels | {label for _, _, label, _ in more})))
        out["score"].append(max([0.6 * bool(base), *(confidence for *_, confidence in more)]))
        out["detections"].append([{"start": a, "end": b, "label": label, "confidence": c} for a, b, label, c in more])
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64()}
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))
    kinds |= {"base_labels": pa.string(), "labels": pa.string(), "detections": spans}
    return {name: pa.array(values, kinds[name]) for name, values in out.items()}


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " detections array<struct<start: long, end: long, label: string, confidence: double>>"
)


def scan_licenses(documents: DataFrame) -> DataFrame:
    """License detections of every whole text, one row per row of ``documents`` (doc_id, text; others are ignored).

    ``detections`` holds byte offsets of the lower-cased UTF-8 text. A null or empty text has no words, no labels,
    score 0 and null first_word and last_word. Repeated rows give repeated results; a null doc_id stays null.
    """
    return map_texts(documents.select("doc_id", F.col("text")), scan, SCHEMA)
