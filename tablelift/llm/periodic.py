"""Periodic runs of words by string synchronising sets.

A run is a stretch of words in which words ``period`` apart are identical, that no neighbouring word extends and that
holds at least four periods. Texts of a batch stand one behind the other as one array of word numbers, longest first,
with a number of its own after each, so that no stretch crosses two texts and every scale works on a prefix.

At the dyadic scale tau, a position is selected if the least hash of the windows of tau words starting at it or at one
of the next tau positions is the first or the last of them. Windows of a period of tau / 4 or less take no part. So the
same words are selected alike wherever they stand (consistency), and of any tau consecutive positions one is selected,
unless 3 * tau - 1 words there have a period of tau / 4 or less (density).

A run of period p with tau <= p < 2 * tau is not such a region, and its first selected position x lies less than tau
after its start. x + p is selected too, both stand before the same 2 * tau words, and no selected position between them
does, since two periods of 2 * tau words would make p a repetition. So neighbours among the selected positions of one
context propose all periods from tau to 2 * tau - 1. Periods below the first scale, which all scales omit, are found
separately as regions of equal words at a small distance; they are also what the scales leave out.

Hashes propose only: proposals are extended by hashes of dyadic windows and then compared word by word. Should two
hashes ever collide, the texts are done again with other hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelift.llm.text import as_bytes, blocks, release, ship_package

#: The least number of periods and of words in a run.
PERIODS, WORDS = 4, 6
#: The first scale. Smaller periods are looked for one by one.
FIRST = 8
#: Bytes of text whose words are in one array.
BLOCK = 1_000_000

RUNS = "array<struct<start:long,length:long,period:long>>"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _numbered(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all lists, each list followed by a negative number of its own, and where each list starts."""
    index: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in lists], np.int64)
    ends = np.cumsum(sizes + 1)
    words = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    inside = np.ones(len(words), bool)
    inside[ends - 1] = False
    words[inside] = np.fromiter((index.setdefault(word, len(index)) for one in lists for word in one), np.int64, int(sizes.sum()))
    words[ends - 1] = -1 - np.arange(len(ends))
    return words, ends - sizes - 1


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _close_runs(words: np.ndarray) -> list[np.ndarray]:
    """Rows (start, end, period) of all stretches of PERIODS periods below FIRST."""
    out = [np.empty((0, 3), np.int64)]
    for period in range(1, FIRST):
        if len(words) > period:
            start, end = _stretches(words[period:] == words[:-period])
            long = end - start >= (PERIODS - 1) * period
            out.append(np.column_stack((start[long], end[long] + period, np.full(int(long.sum()), period))))
    return out


class _Windows:
    """Hashes of the windows of 2**k words, computed when they are first asked for."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        self.levels = [_mixed(words.view(np.uint64) * _A + np.uint64(seed))]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            if len(last) <= half:
                return last[:0]
            self.levels.append(_mixed(last[:-half] * _A + last[half:] * _C + np.uint64(len(self.levels))))
        return self.levels[k]

    def extended(self, a: np.ndarray, period: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``a`` on (or before it) equal those ``period`` later."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            active = np.arange(len(a))
            while len(active):
                at = a[active] + total[active] if forward else a[active] - total[active] - step
                inside = (at >= 0) & (at + period[active] < len(level))
                active, at = active[inside], at[inside]
                same = level[at] == level[at + period[active]]
                active = active[same]
                total[active] += step
        return total


def _selected(windows: _Windows, k: int, regions: list[np.ndarray], size: int) -> np.ndarray:
    """The synchronising set of the scale 2**k among the first ``size`` positions."""
    tau = 1 << k
    hashes = windows.level(k)[:size].copy()
    size = len(hashes)
    if size <= tau:
        return np.empty(0, np.int64)
    none = np.iinfo(np.uint64).max
    periodic = [rows[(rows[:, 2] * 4 <= tau) & (rows[:, 1] - rows[:, 0] >= tau)] for rows in regions]
    marks = np.zeros(size + 1, np.int64)
    for rows in periodic:
        np.add.at(marks, np.minimum(rows[:, 0], size), 1)
        np.add.at(marks, np.minimum(rows[:, 1] - tau + 1, size), -1)
    hashes[np.cumsum(marks[:-1]) > 0] = none
    least = hashes
    for step in (1 << j for j in range(k)):
        least = np.minimum(least[:-step], least[step:])
    # ``least`` covers tau windows; two of them, one position apart, cover the tau + 1 that decide.
    least = np.minimum(least[:-1], least[1:])
    first = hashes[: len(least)]
    last = hashes[tau : tau + len(least)]
    return np.flatnonzero((least != none) & ((first == least) | (last == least)))


def _collides(words: np.ndarray, rows: np.ndarray) -> bool:
    for start, end, period in rows.tolist():
        same = words[start : end - period] == words[start + period : end]
        before = start > 0 and words[start - 1] == words[start - 1 + period]
        if not same.all() or before or (end < len(words) and words[end] == words[end - period]):
            return True
    return False


def _array_runs(words: np.ndarray, starts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Rows (start, end, period) of all runs of an array of lists, longest list first, sorted by start and period."""
    sizes = np.diff(np.append(starts, len(words))) - 1
    regions = _close_runs(words)
    windows, k = _Windows(words, seed), FIRST.bit_length() - 1
    while True:
        tau = 1 << k
        lists = int(np.count_nonzero(sizes >= PERIODS * tau))
        if not lists:
            break
        size = int(starts[lists - 1] + sizes[lists - 1] + 1)
        chosen = _selected(windows, k, regions, size)
        context = windows.level(k + 1)
        chosen = chosen[chosen < len(context)]
        order = np.argsort(context[chosen], kind="stable")
        place, same = chosen[order], context[chosen][order]
        gap = place[1:] - place[:-1]
        pair = np.flatnonzero((same[1:] == same[:-1]) & (gap >= tau) & (gap < 2 * tau))
        a, period = place[pair], gap[pair]
        if len(a):
            start = a - windows.extended(a, period, forward=False)
            end = a + windows.extended(a, period, forward=True) + period
            long = end - start >= PERIODS * period
            found = np.unique(np.column_stack((start, end, period))[long], axis=0)
            if _collides(words, found):
                return _array_runs(words, starts, seed + 1)
            regions.append(found)
        k += 1
    every = np.concatenate(regions)
    every = every[every[:, 1] - every[:, 0] >= WORDS]
    # A stretch found under several periods has the smallest of them; the others are its multiples.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    fresh = np.ones(len(every), bool)
    fresh[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[fresh]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _batch(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[bytes], list[int]]:
    """Of each text its runs (start, length, period), its words without the repetitions, and its number of words."""
    split = [text.split() for text in texts]
    order = sorted(range(len(split)), key=lambda k: -len(split[k]))
    words, starts = _numbered([split[k] for k in order])
    rows = _array_runs(words, starts)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    dropped = np.cumsum(change[:-1]) > 0
    owner = np.searchsorted(starts, rows[:, 0], side="right") - 1
    found: list = [[] for _ in texts]
    kept: list = [None] * len(texts)
    for list_, (start, end, period) in zip(owner.tolist(), rows.tolist(), strict=True):
        found[order[list_]].append((start - int(starts[list_]), end - start, period))
    for list_, text in enumerate(order):
        one, at = split[text], int(starts[list_])
        if found[text]:
            one = [one[k] for k in np.flatnonzero(~dropped[at : at + len(one)]).tolist()]
        kept[text] = b" ".join(one)
    return found, kept, [len(one) for one in split]


def find_runs(documents: DataFrame) -> DataFrame:
    """Runs of the words of every text, and the text without the repetitions.

    Returns doc_id, n_words, runs (start, length and period, by start and period) and collapsed: the words joined by
    one space, without those that a run holds after its first period. Words are ended by ASCII white space. A null,
    empty or blank text has no words, no runs and an empty collapsed text. Every row has a row in the result, null
    and repeated ids too; an empty table gives none. Columns other than doc_id and text are ignored.
    """
    ship_package(documents.sparkSession)
    frame = documents.select("doc_id", "text")
    kind = frame.schema["doc_id"].dataType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for begin, end in blocks(texts, BLOCK):
                found, kept, sizes = _batch(texts[begin:end])
                flat = np.array([row for rows in found for row in rows], np.int64).reshape(-1, 3)
                offsets = np.cumsum([0, *map(len, found)])
                parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts).cast(runs_type)
                columns = [batch.column(0).slice(begin, end - begin), pa.array(sizes, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return frame.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text of all documents; a tenth of them, by a hash of doc_id, repeat some of their words to the end."""
    hash_ = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    frame = documents.select("doc_id", "text", hash_.alias("h"))
    # The words are taken apart only where they are changed.
    words = F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), word -> word != '')"))
    frame = frame.withColumn("words", words).withColumn("n", F.size("words"))
    first = F.expr("if(n > 0, (h div 10) % n, null)")
    frame = frame.withColumn("a", first).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    planted = F.expr("array_join(transform(words, (word, i) -> if(i < a, word, words[int(a + (i - a) % p)])), ' ')")
    return frame.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The run of the greatest exact length by period of each document, and digests of its runs and collapsed text.

    Fractions are compared by multiplying crosswise. Runs come by start and period, so the first of equals stays.
    """
    best = F.expr(f"""aggregate(runs, cast(null as {RUNS[6:-1]}), (best, run) ->
        if(best is null or run.length * best.period > best.length * run.period, run, best))""")
    lines = F.expr(r"array_join(transform(runs, run -> concat(run.start, ',', run.length, ',', run.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
