"""Quality classifier: additive model with pairwise interactions, cyclic boosted shallow trees as lookup tables."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablelift.llm.text import map_texts, sampled_texts

#: Documents per label value, and the longest of them, in the bounded sample that the tables are learned from.
SAMPLE_ROWS, SAMPLE_LONGEST = 6_000, 200_000
#: Bins per feature and per side of a pair, boosting rounds, step, pairs kept, least weight of a leaf.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, STEP, PAIRS, LEAST = 32, 8, 120, 40, 0.15, 6, 8.0

FEATURES = (
    "log_words", "word_length", "distinct_share", "line_words", "duplicate_lines", "lower_share", "upper_share",
    "digit_share", "symbol_share", "stop_share", "bang_share", "bar_share", "space_share", "wide_share",
    "top_share", "repeat_share", "markup_share", "odd_end_share",
)

#: Byte classes.
_CLASS = np.zeros(256, np.uint8)
for _name, _members in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>^~`\\=+_@{}[]/", b".,;:'\"()-?",
    b"!", b"|", b" \t\n\r\x0b\x0c", bytes(range(128, 256)),
), 1):
    _CLASS[list(_members)] = _name
_MARKUP = re.compile(rb"https?:|www\.|</?[a-z]|\{|\}|;\n")


def features(text: bytes) -> list[float]:
    """Numbers about one whole text; all zero if it has no word."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10)
    lines = [line for line in text.split(b"\n") if line.strip()]
    lowered = text.lower().split()
    counted = Counter(lowered)
    pairs = n - 1 and len(set(zip(lowered, lowered[1:], strict=False)))
    ended = sum(1 for word in words if word[-1:] in b"#*$%&|!>")
    common = max(counted.values())
    return [
        float(np.log1p(n)),
        (size - counts[8]) / n,
        len(counted) / n**0.8,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        *(float(counts[kind]) / size for kind in (1, 2, 3, 4, 5, 6, 7, 8, 9)),
        common / n,
        1 - pairs / (n - 1) if n > 1 else 0.0,
        len(_MARKUP.findall(text)) / n,
        ended / n,
    ]


@dataclass(frozen=True)
class GamModel:
    """edges: bin edges per feature; tables: one table of additions per feature; pairs: (a, b, edges of a, edges of b, table)."""

    intercept: float
    edges: tuple
    tables: tuple
    pairs: tuple


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(residual: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins: leaf value per bin from sums of gradients and curvatures."""
    out = np.full(len(residual), residual.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(residual) < 2:
        return out
    left_r, left_w = np.cumsum(residual)[:-1], np.cumsum(weight)[:-1]
    right_r, right_w = residual.sum() - left_r, weight.sum() - left_w
    gain = np.where((left_w >= LEAST / 4) & (right_w >= LEAST / 4), left_r**2 / (left_w + 1) + right_r**2 / (right_w + 1), -1.0)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= residual.sum() ** 2 / (weight.sum() + 1) + 1e-9:
        return out
    return np.concatenate((_tree(residual[:cut], weight[:cut], depth - 1), _tree(residual[cut:], weight[cut:], depth - 1)))


def _grid(residual: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A four-leaf tree over a grid of bins: the best cut of the first side, then the best cut of the second in each half."""
    best, table = -1.0, np.zeros_like(residual)
    for cut in range(1, residual.shape[0]):
        halves, gain = [], 0.0
        for part in (slice(0, cut), slice(cut, None)):
            leaf = _tree(residual[part].sum(0), weight[part].sum(0), 1)
            halves.append(np.broadcast_to(leaf, residual[part].shape))
            gain += float((leaf**2 * (weight[part].sum(0) + 1 / len(leaf))).sum())
        if gain > best:
            best, table = gain, np.concatenate(halves)
    return table


def fit_numbers(x: np.ndarray, y: np.ndarray) -> GamModel:
    """Fit on a feature matrix and 0/1 labels: main effects first, then pairs on what is left."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    intercept = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return GamModel(intercept, tuple(np.zeros(0) for _ in FEATURES), tuple(np.zeros(1) for _ in FEATURES), ())
    edges = [_edges(column, BINS) for column in x.T]
    bins = [np.searchsorted(edge, column, side="right") for edge, column in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(edge) + 1) for edge in edges]
    margin = np.full(len(y), intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for place, column in enumerate(bins):
            residual, weight = gradients()
            sums = [np.bincount(column, part, len(tables[place])) for part in (residual, weight)]
            step = STEP * np.clip(_tree(*sums), -4, 4)
            tables[place] += step
            margin += step[column]
    coarse = [_edges(column, PAIR_BINS) for column in x.T]
    small = [np.searchsorted(edge, column, side="right") for edge, column in zip(coarse, x.T, strict=True)]

    def sums_of(a: int, b: int) -> list[np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = small[a] * shape[1] + small[b]
        return [np.bincount(cell, part, shape[0] * shape[1]).reshape(shape) for part in gradients()]

    ranked = []
    for a in range(len(FEATURES)):
        for b in range(a):
            residual, weight = sums_of(b, a)
            ranked.append((float((_grid(residual, weight) * residual).sum()), b, a))
    chosen = [(a, b) for _, a, b in sorted(ranked, key=lambda one: (-one[0], one[1:]))[:PAIRS]]
    grids = {pair: np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1)) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            step = STEP * np.clip(_grid(*sums_of(a, b)), -4, 4)
            grids[a, b] += step
            margin += step[small[a], small[b]]
    pairs = tuple((a, b, coarse[a], coarse[b], grid) for (a, b), grid in grids.items())
    return GamModel(intercept, tuple(edges), tuple(tables), pairs)


def margins(model: GamModel, x: np.ndarray) -> np.ndarray:
    """Log-odds of label 1: one addition per feature and pair, looked up by bin."""
    total = np.full(len(x), model.intercept)
    for place, (edge, table) in enumerate(zip(model.edges, model.tables, strict=True)):
        total += table[np.searchsorted(edge, x[:, place], side="right")]
    for a, b, edge_a, edge_b, grid in model.pairs:
        total += grid[np.searchsorted(edge_a, x[:, a], side="right"), np.searchsorted(edge_b, x[:, b], side="right")]
    return total


def learn(documents: DataFrame, labelled: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> GamModel:
    """Fit on a bounded sample of ``labelled`` (doc_id, label 0/1; null labels are ignored)."""
    sample = sampled_texts(documents, labelled.dropna(), "label", rows, longest)
    return fit_sample(sample)


def fit_sample(sample: list[tuple[bytes, int]]) -> GamModel:
    x = np.array([features(text) for text, _ in sample], dtype=float).reshape(len(sample), len(FEATURES))
    return fit_numbers(x, np.array([float(label) for _, label in sample]))


def score_quality(documents: DataFrame, model: GamModel, threshold: float = 0.7, balance: float = 0.0) -> DataFrame:
    """Quality of every whole text: score (chance of label 1) and predicted.

    ``balance`` is added to the log-odds, for a sample whose label shares differ from the table's. One row per row
    of ``documents`` with all columns but text. Null, empty and wordless texts have all features 0 and a score like
    any other; ties cannot arise, a row is scored by itself; repeated rows repeat.
    """

    def score(texts: list[bytes]) -> dict:
        x = np.array([features(text) for text in texts], dtype=float).reshape(len(texts), len(FEATURES))
        chance = 1 / (1 + np.exp(-np.clip(margins(model, x) + balance, -30, 30)))
        return {"score": pa.array(chance, pa.float64()), "predicted": pa.array((chance >= threshold).astype(np.int32))}

    return map_texts(documents, score, "score double, predicted int")
