"""Language ID: a linear-chain conditional random field labels the words of (code-switched) text.

A word's features are its affixes, its inner character n-grams and itself as an entry of a learned lexicon, each
with one learned weight per language; transitions between the labels of neighbouring words are learned too.
Posteriors come from forward-backward; a document's language is the one with the largest posterior share of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelift.llm.text import blocks, map_texts, sampled_texts

#: Documents per language, and the longest of them, in the bounded sample that the field is fitted on.
SAMPLE_ROWS, SAMPLE_LONGEST = 400, 50_000
#: Hashed weights per feature kind, lengths of the n-grams (word edges count as a character).
BUCKETS, GRAMS = 1 << 17, (2, 3, 4)
#: Words per chain: a longer text is several chains whose posteriors add up.
CHAIN = 1024
#: Passes over the sample, step, pull towards zero, chains per step, words per training chain, words per switch.
EPOCHS, STEP, PULL, CHAINS_PER_STEP, TRAIN_CHAIN, SWITCH = 3, 0.15, 1e-6, 64, 96, 24

_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


@dataclass(frozen=True)
class CrfModel:
    """grams, lexicon: BUCKETS x languages weights; start, transitions: log scores; langs: sorted label values."""

    langs: tuple
    grams: np.ndarray
    lexicon: np.ndarray
    start: np.ndarray
    transitions: np.ndarray


def has_letter(text: bytes) -> bool:
    plain = np.frombuffer(text, np.uint8)
    if bool(((plain | 32) - 97 < 26).any()):
        return True
    return bool((plain >= 128).any()) and any(letter.isalpha() for letter in text.decode(errors="replace"))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words with a 0 before each, place of each word's 0, number of words of each text."""
    joined = b"\n".join(texts).decode(errors="replace").lower().encode()
    flat = np.frombuffer(joined, np.uint8)
    inside = _LETTER[flat]
    first = inside & ~np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(first)
    # Lower-casing can change a text's size: texts are told apart by counting the words before each joint.
    if joined.count(b"\n") == len(texts) - 1:
        ends = np.concatenate((np.flatnonzero(flat == 10), [len(flat)]))
    else:
        sizes = [len(text.decode(errors="replace").lower().encode()) for text in texts]
        ends = np.cumsum(np.array(sizes, np.int64) + 1) - 1
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    keep = inside.copy()
    keep[np.maximum(starts - 1, 0)] = True
    # A word at the very start has no byte before it.
    head = bool(len(flat)) and bool(inside[0])
    kept = flat[keep].copy()
    kept[~inside[keep]] = 0
    if head:
        kept = np.concatenate((np.zeros(1, np.uint8), kept))
    return kept, np.flatnonzero(kept == 0), counts


def _hashes(letters: np.ndarray, heads: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram that begins at each place (BUCKETS where there is none) and of each whole word."""
    wide = np.concatenate((letters, np.zeros(max(GRAMS), np.uint8))).astype(np.uint64)
    size = len(letters)
    found, code = [], wide[:size].copy()
    valid = np.ones(size, bool)
    for n in range(2, max(GRAMS) + 1):
        if n > 2:
            valid &= wide[n - 2 : n - 2 + size] != 0
        code = code * np.uint64(257) + wide[n - 1 : n - 1 + size] + np.uint64(1)
        bucket = ((code * np.uint64(_MIX[n % 4])) >> np.uint64(47)).astype(np.int32)
        if n in GRAMS:
            found.append(np.where(valid, bucket, BUCKETS))
    place = np.arange(size) - np.repeat(heads, np.diff(np.concatenate((heads, [size]))))
    power = np.multiply.accumulate(np.full(int(place.max()) + 1 if size else 1, 0x100000001B3, np.uint64))
    whole = np.add.reduceat(wide[:size] * power[place], heads) if len(heads) else np.zeros(0, np.uint64)
    return found, ((whole * np.uint64(_MIX[0])) >> np.uint64(47)).astype(np.int32)


def emissions(model: CrfModel, letters: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Log score of every label at every word."""
    if not len(heads):
        return np.zeros((0, len(model.langs)), np.float32)
    grams, whole = _hashes(letters, heads)
    total = model.grams[grams[0]]
    for bucket in grams[1:]:
        total += model.grams[bucket]
    return np.add.reduceat(total, heads, axis=0) + model.lexicon[whole]


def posteriors(model: CrfModel, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every label at every word of chains laid end to end, and expected transitions of all chains."""
    labels = scores.shape[1]
    if not len(scores):
        return np.zeros((0, labels)), np.zeros((labels, labels))
    used = lengths[lengths > 0]
    order = np.argsort(-used, kind="stable")
    firsts = (np.cumsum(used) - used)[order]
    sizes = used[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    # Rows ordered by step, then by chain: the chains that reach a step are a prefix of those of the step before.
    offsets = np.concatenate(([0], np.cumsum(active)))
    rows = np.empty(len(scores), np.int64)
    for t in range(longest):
        rows[offsets[t] : offsets[t + 1]] = firsts[: active[t]] + t
    local = scores[rows].astype(np.float64)
    local = np.exp(local - local.max(axis=1, keepdims=True))
    move = np.exp(model.transitions)
    forward = np.empty_like(local)
    now = local[: active[0]] * np.exp(model.start)
    forward[: active[0]] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, longest):
        a, b = offsets[t], offsets[t + 1]
        now = (forward[offsets[t - 1] : offsets[t - 1] + active[t]] @ move) * local[a:b]
        forward[a:b] = now / now.sum(axis=1, keepdims=True)
    backward = np.ones_like(local)
    pairs = np.zeros((labels, labels))
    for t in range(longest - 1, 0, -1):
        a, b, before = offsets[t], offsets[t + 1], offsets[t - 1]
        tail = local[a:b] * backward[a:b]
        back = tail @ move.T
        backward[before : before + active[t]] = back / back.sum(axis=1, keepdims=True)
        alpha = forward[before : before + active[t]]
        weight = 1 / np.einsum("ij,ij->i", alpha, back)
        pairs += ((alpha * weight[:, None]).T @ tail) * move
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    out = np.empty_like(both)
    out[rows] = both
    return out, pairs


def fit(sample: list[tuple[bytes, str]], seed: int = 7) -> CrfModel:
    """Fit by stochastic gradients on chains that switch language between runs of sampled words."""
    langs = tuple(sorted({lang for _, lang in sample}))
    count = len(langs)
    grams, lexicon = (np.zeros((BUCKETS + 1, count), np.float32) for _ in range(2))
    model = CrfModel(langs, grams, lexicon, np.zeros(count), np.zeros((count, count)))
    chooser = np.random.default_rng(seed)
    runs: list[tuple[int, bytes]] = []
    for text, lang in sample:
        words = text.split()
        cuts = np.cumsum(chooser.integers(1, 2 * SWITCH, len(words) // SWITCH + 2))
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(words)])), strict=True):
            if a < len(words) and has_letter(b" ".join(words[a:b])):
                runs.append((langs.index(lang), b" ".join(words[a:b])))
    if not runs or count < 2:
        return model
    squares = [np.full_like(part, 1e-2) for part in (grams, lexicon)]
    squares += [np.full(count, 1e-2), np.full((count, count), 1e-2)]
    per_step = CHAINS_PER_STEP * (TRAIN_CHAIN // SWITCH)
    for _ in range(EPOCHS):
        order = chooser.permutation(len(runs))
        for begin in range(0, len(order), per_step):
            chosen = [runs[place] for place in order[begin : begin + per_step]]
            letters, heads, counts = words_of([text for _, text in chosen])
            truth = np.repeat([lang for lang, _ in chosen], counts)
            ends = np.cumsum(counts)
            chain_ends = np.unique(np.append(ends[TRAIN_CHAIN // SWITCH - 1 :: TRAIN_CHAIN // SWITCH], ends[-1]))
            lengths = np.diff(np.concatenate(([0], chain_ends)))
            guess, expected = posteriors(model, emissions(model, letters, heads), lengths)
            error = (np.eye(count)[truth] - guess).astype(np.float32)
            firsts = (chain_ends - lengths)[lengths > 0]
            same_chain = np.ones(len(truth), bool)
            same_chain[firsts] = False
            seen = np.zeros((count, count))
            np.add.at(seen, (truth[np.flatnonzero(same_chain) - 1], truth[same_chain]), 1)
            buckets, whole = _hashes(letters, heads)
            spread = np.repeat(error, np.diff(np.concatenate((heads, [len(letters)]))), axis=0)
            places = np.concatenate(buckets)
            steps = (
                np.stack([np.bincount(places, np.tile(spread[:, k], len(buckets)), BUCKETS + 1) for k in range(count)], 1),
                np.stack([np.bincount(whole, error[:, k], BUCKETS + 1) for k in range(count)], 1),
                error[firsts].sum(axis=0),
                seen - expected,
            )
            for part, square, step in zip((grams, lexicon, model.start, model.transitions), squares, steps, strict=True):
                step = step - PULL * part * len(truth)
                square += step * step
                part += (STEP * step / np.sqrt(square)).astype(part.dtype)
            grams[BUCKETS] = 0
    return model


def label_texts(model: CrfModel, texts: list[bytes]) -> dict:
    """Language, posterior share and number of label changes of each text."""
    if not model.langs:
        size = len(texts)
        return {"lang_pred": pa.array(["und"] * size), "score": pa.array([0.0] * size), "n_switches": pa.array([0] * size, pa.int64())}
    parts, counts = [], []
    for start, end in blocks(texts, 1_000_000):
        letters, heads, found = words_of(texts[start:end])
        parts.append(emissions(model, letters, heads))
        counts.append(found)
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    scores = np.concatenate(parts) if parts else np.zeros((0, len(model.langs)))
    full, rest = sizes // CHAIN, sizes % CHAIN
    chains = np.repeat(np.column_stack((np.full(len(sizes), CHAIN), rest)).ravel(), np.column_stack((full, np.ones_like(full))).ravel())
    guess, _ = posteriors(model, scores, chains)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = np.stack([np.bincount(owner, guess[:, k], len(sizes)) for k in range(guess.shape[1])], 1).astype(float)
    share /= np.maximum(sizes, 1)[:, None]
    label = guess.argmax(axis=1)
    changes = np.bincount(owner[1:], (label[1:] != label[:-1]) & (owner[1:] == owner[:-1]), len(sizes)) if len(owner) else np.zeros(len(sizes))
    known = [has_letter(text) and size > 0 for text, size in zip(texts, sizes, strict=True)]
    best = share.argmax(axis=1)
    return {
        "lang_pred": pa.array([model.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)], pa.string()),
        "score": pa.array([float(min(1.0, share[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, known, strict=True))], pa.float64()),
        "n_switches": pa.array(changes.astype(np.int64), pa.int64()),
    }


def learn(documents: DataFrame, labelled: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> CrfModel:
    """Fit on a bounded sample of ``labelled`` (doc_id, label); null labels are ignored."""
    return fit(sampled_texts(documents, labelled.dropna(subset=["label"]), "label", rows, longest))


def identify_language(documents: DataFrame, model: CrfModel) -> DataFrame:
    """Language of every whole text: lang_pred, score (posterior share of its words), n_switches.

    One row per row of ``documents`` with all columns but text. A text that is null, empty or without a letter is
    ``und`` with score 0, as is every text when nothing was learned. Of languages with equal shares the first by
    name wins. Repeated rows give repeated results.
    """
    return map_texts(documents, lambda texts: label_texts(model, texts), "lang_pred string, score double, n_switches long")


def accepted(found: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows whose language could be told: there is a letter, and one language holds the least share of the words."""
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
