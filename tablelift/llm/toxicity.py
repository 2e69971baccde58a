"""Toxic passages: maximum-scoring segments over Dirichlet log-odds, calibrated as extreme values."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelift.llm.text import map_texts, sampled_texts

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Documents per label value, and the longest of them, in the bounded sample that the log-odds are learned from.
SAMPLE_ROWS, SAMPLE_LONGEST = 4_000, 200_000
#: Weight of the Dirichlet prior: a part's prior count on either side is this share of its count in the sample.
PRIOR_SHARE = 0.03
#: Standard errors by which a log-odds must lie above zero to count, and the score of any other word.
Z_LEAST, OTHER = 3.0, -0.35
#: Evidence beyond which more does not count.
MOST_EVIDENCE = 40.0
#: Folds of the sample that the calibration is fitted over.
FOLDS = 4
#: Lengths in bytes of the word beginnings that have log-odds of their own, for words that take many endings; the
#: toxic documents of the sample that a word or beginning must occur in; words that a task remembers scores of.
BEGINNINGS, LEAST_DOCUMENTS, REMEMBERED = (4, 5, 6, 7), 4, 500_000


@dataclass(frozen=True)
class ToxicModel:
    """weights: log-odds of words and beginnings that stand out; rate, constant: of the extreme-value law; slope, offset: its link."""

    weights: dict
    rate: float
    constant: float
    slope: float
    offset: float


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, found in one pass over its positive places.

    A stack holds disjoint candidates with the running totals before and after them; a new place joins those that
    it makes longer with more score, so every place enters and leaves the stack once.
    """
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float]] = []
    lowest: list[float] = []
    for place in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = place, place + 1, float(totals[place]), float(totals[place + 1])
        while stack:
            # The nearest candidate that starts lower; those that start higher or as high are passed for good only
            # when the new segment swallows them.
            back = len(stack) - 1
            while back >= 0 and stack[back][2] >= before:
                back = lowest[back]
            if back < 0 or stack[back][3] >= after:
                break
            start, before = stack[back][0], stack[back][2]
            del stack[back:], lowest[back:]
        back = len(stack) - 1
        while back >= 0 and stack[back][2] >= before:
            back = lowest[back]
        stack.append((start, end, before, after))
        lowest.append(back)
    return [(start, end, after - before) for start, end, before, after in stack]


def _parts(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked as such."""
    return [word, *(word[:size] + b"*" for size in BEGINNINGS if len(word) > size)]


class WordScores(dict):
    """Score of a word: the best log-odds of the word and its beginnings, else OTHER."""

    def __init__(self, weights: dict) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        score = max([self.weights.get(part, OTHER) for part in _parts(word)])
        self[word] = score
        return score


def _word_scores(text: bytes, known: WordScores) -> np.ndarray:
    return np.array([known[word] for word in _WORD.findall(text.lower())], dtype=float)


def best_segment(scores: np.ndarray) -> float:
    """Score of the best segment, 0 if no word is positive."""
    if not len(scores) or scores.max() <= 0:
        return 0.0
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    return float((totals[1:] - np.minimum.accumulate(totals[:-1])).max())


def log_odds(texts: list[bytes], toxic: np.ndarray) -> dict[bytes, float]:
    """Log-odds of the words and beginnings that stand out on the toxic side, under an informative Dirichlet prior."""
    # A part counts once per document, and a document once, so that copies are not taken for many witnesses.
    # Parts of few toxic documents cannot stand out, so the clean side counts only what is left of the toxic side.
    documents: dict[bool, dict[int, bytes]] = {False: {}, True: {}}
    for text, label in zip(texts, toxic.tolist(), strict=True):
        documents[label][hash(frozenset(_WORD.findall(text.lower())))] = text
    sides, totals = (Counter(), Counter()), [0, 0]
    for label in (True, False):
        for text in documents[label].values():
            found = {part for word in set(_WORD.findall(text.lower())) for part in _parts(word)}
            totals[label] += len(found)
            sides[label].update(found if label else found & sides[True].keys())
        if label:
            for part in [part for part, count in sides[True].items() if count < LEAST_DOCUMENTS]:
                del sides[True][part]
    prior_total = PRIOR_SHARE * sum(totals)
    weights = {}
    for word in sides[True]:
        prior = PRIOR_SHARE * (sides[0][word] + sides[1][word])
        odds, errors = [], 0.0
        for side, total in zip(sides, totals, strict=True):
            seen_here = side[word] + prior
            odds.append(np.log(seen_here / (total + prior_total - seen_here)))
            errors += 1 / seen_here
        gap = float(odds[1] - odds[0])
        if gap - Z_LEAST * errors**0.5 > 0 and gap > 1.0:
            weights[word] = gap
    return weights


def segment_scores(scores: np.ndarray) -> np.ndarray:
    """Scores of all segments, the best first."""
    return np.sort(np.array([score for _, _, score in segments(scores)], dtype=float))[::-1]


def fit(rows: list[tuple[bytes, int]]) -> ToxicModel:
    """Fit on (text, label) rows; without rows of both labels every document scores alike, far below any threshold."""
    toxic = np.array([bool(label) for _, label in rows], dtype=bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return ToxicModel({}, 1.0, 1.0, 0.0, -4.0 if not toxic.all() or not len(rows) else 4.0)
    # Words chosen on a text look better on it than on others: the law and its link are fitted on scores of each fold
    # of the sample by the words of the other folds.
    fold = np.array([zlib.crc32(text) % FOLDS for text, _ in rows])
    scores = [np.zeros(0)] * len(rows)
    for side in (fold != number for number in range(FOLDS)):
        own = side if toxic[side].any() and not toxic[side].all() else np.ones(len(rows), bool)
        known = WordScores(log_odds([row[0] for row, is_own in zip(rows, own, strict=True) if is_own], toxic[own]))
        for place in np.flatnonzero(~side):
            scores[place] = _word_scores(rows[place][0], known)
    found, lengths = [segment_scores(one) for one in scores], [max(1, len(one)) for one in scores]
    rate = _rate(scores, toxic)
    # Of clean documents: the number of segments above a score s is about constant * words * exp(-rate * s).
    clean = np.flatnonzero(~toxic)
    chance = np.sort(np.concatenate([found[place] for place in clean]))
    words = sum(lengths[place] for place in clean)
    level = float(np.median(chance)) if len(chance) else 1.0
    constant = max(1.0, float((chance >= level).sum())) / words * float(np.exp(rate * level))
    evidence = np.array([_evidence(one, size, rate, constant) for one, size in zip(found, lengths, strict=True)])
    slope, offset = _logistic(evidence, toxic.astype(float))
    return ToxicModel(log_odds([text for text, _ in rows], toxic), rate, constant, slope, offset)


def _rate(scores: list[np.ndarray], toxic: np.ndarray) -> float:
    """The positive root of mean(exp(rate * score)) = 1 over words of clean documents."""
    values, counts = np.unique(np.concatenate([one for one, label in zip(scores, toxic, strict=True) if not label] or [np.array([OTHER])]), return_counts=True)
    if not len(values) or values.max() <= 0:
        return 1.0
    share, low, high = counts / counts.sum(), 1e-6, 50.0 / max(1.0, values.max())
    for _ in range(80):
        middle = (low + high) / 2
        if float(share @ np.exp(middle * values)) > 1:
            high = middle
        else:
            low = middle
    return low


def _tails(mean: np.ndarray) -> np.ndarray:
    """Minus log of the chance that a Poisson law of mean[r - 1] gives r or more, for r = 1, 2, ..."""
    r = np.arange(1, len(mean) + 1, dtype=float)
    # Above the mean the terms from r on fall, below it those from r - 1 down do: either sum starts with its largest.
    upper = r > mean
    first = np.where(upper, r, r - 1)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(r))))[first.astype(int)]
    log_term = first * np.log(mean) - mean - log_factorial
    term, total, step, open_ = np.ones(len(r)), np.ones(len(r)), 0, np.arange(len(r))
    while len(open_):
        at, m = first[open_], mean[open_]
        term[open_] *= np.where(upper[open_], m / (at + step + 1), np.maximum(at - step, 0) / m)
        total[open_] += term[open_]
        step += 1
        open_ = open_[term[open_] > 1e-16 * total[open_]]
    log_sum = np.minimum(log_term + np.log(total), 0.0)
    return np.where(upper, -log_sum, -np.log1p(-np.minimum(np.exp(log_sum), 1 - 1e-16)))


def _evidence(scores: np.ndarray, length: int, rate: float, constant: float) -> float:
    """Minus log of the least chance, over all r, that a clean text of this length has r segments as good as the r-th best.

    Segments above a score come by chance like a Poisson law whose mean is the extreme-value expectation.
    """
    if not len(scores):
        return 0.0
    mean = np.maximum(constant * length * np.exp(-rate * scores), 1e-250)
    return float(min(max(0.0, _tails(mean).max()), MOST_EVIDENCE))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps on a logistic link with a weak pull of the slope to 0."""
    design, beta = np.column_stack((x, np.ones_like(x))), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((design.T * weight) @ design + 0.1 * np.eye(2), design.T @ (y - p) - 0.1 * beta)
        beta = beta + step
        if float(np.abs(step).max()) < 1e-9:
            break
    return float(beta[0]), float(beta[1])


SCHEMA = "score double, predicted int, n_segments long, segments array<struct<start: long, end: long, score: double>>"


def score_texts(model: ToxicModel, texts: list[bytes], threshold: float, known: WordScores | None = None) -> dict:
    known = WordScores(model.weights) if known is None else known
    evidence, found = [], []
    for text in texts:
        scores = _word_scores(text, known)
        length = max(1, len(scores))
        parts = segments(scores)
        strength = np.sort(np.array([s for _, _, s in parts], dtype=float))[::-1]
        evidence.append(_evidence(strength, length, model.rate, model.constant))
        limit = model.constant * length
        found.append([{"start": a, "end": b, "score": s} for a, b, s in parts if limit * np.exp(-model.rate * s) <= 0.5])
    score = 1 / (1 + np.exp(-np.clip(model.slope * np.array(evidence, dtype=float) + model.offset, -30, 30)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    return {
        "score": pa.array(score, pa.float64()),
        "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32()),
        "n_segments": pa.array([len(one) for one in found], pa.int64()),
        "segments": pa.array(found, kind),
    }


def learn(documents: DataFrame, labelled: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> ToxicModel:
    """Fit on a bounded sample of ``labelled`` (doc_id, label 0/1; null labels are ignored).

    The sample holds more toxic documents than the table; the link's offset is moved back to the table's share.
    """
    known = labelled.dropna()
    sample = sampled_texts(documents, known, "label", rows, longest)
    model = fit(sample)
    toxic, every = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    drawn = sum(1 for _, label in sample if label)
    if not (0 < drawn < len(sample) and 0 < toxic < every):
        return model
    shift = math.log(toxic / (every - toxic)) - math.log(drawn / (len(sample) - drawn))
    return replace(model, offset=model.offset + shift)


def score_toxicity(documents: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """Toxicity of every whole text: score, predicted and the significant segments in word positions.

    One row per row of ``documents`` with all columns but text. A null, empty or wordless text scores as a document
    without any segment. Ties between segments are kept as the single pass finds them; repeated rows repeat.
    """
    known = WordScores(model.weights)
    return map_texts(documents, lambda texts: score_texts(model, texts, threshold, known), SCHEMA)
