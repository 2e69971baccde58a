"""Packing: token sequences filled by non-negative least squares over a histogram of piece lengths.

Every document is tokenized once and cut into full windows and one rest. Rests are counted in bins; shallow
combinations of bins that fill a window get repeat counts by non-negative least squares, rounded down; what is left
is packed greedily. Only the histogram (one number per bin) is solved on the driver: pieces find their sequence by
their rank inside their bin. Rests that no combination fills well are cut in two at a hashed place and packed in a
second round.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelift.llm.text import as_bytes, blocks, give_back, held, ship_package
from tablelift.session import materialize

#: Tokens of a sequence, tokens of a bin, parts of an enumerated combination.
WINDOW, BIN, DEPTH = 4096, 16, 3
#: Bins that a combination of the first round may leave empty.
SLACK = 3
#: Id at the end of every document.
END_ID = 2
#: Pieces that are ranked together, and the most such groups per bin.
RANKED, RANK_GROUPS = 1000, 4096
#: Bytes of words and ids after which a worker's cache of tokenized words is started anew, and what an entry takes besides.
CACHED_BYTES, ENTRY_BYTES = 64_000_000, 180

#: Bytes of text that are tokenized at once.
BLOCK_BYTES = 4_000_000

#: Pre-tokens whose borders are known without the tokenizer, and the text they are known for: ASCII and Latin letters, in
#: which lower case and composition change no letter's kind and no special token can stand.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD = r"[^\t-\r -~À-ÖØ-öø-ÿ]|<\|"
_BETWEEN_LETTERS = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+)"


class WordTokens:
    """Ids of whole texts, equal to those of the tokenizer, which sees every pre-token once.

    It serves tokenizers that drop white space. Where one lower-cases and splits as ``_SPLIT`` says, texts are cut into
    pre-tokens column-wise, and each that is not cached goes through the tokenizer's model. Any other word, or any word
    of another tokenizer, is encoded by itself.
    """

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.splits = _splits_as_known(json.loads(tokenizer_json))
        self._clear()

    def _clear(self) -> None:
        self.size, self.ids, self.starts = 0, np.zeros(0, "<u4"), np.zeros(2, np.int64)
        self.numbers: dict[str, int] = {"": 0}

    def _learn(self, parts: list[str], words: list[str]) -> None:
        """Ids of new pre-tokens and of new words."""
        found: list[list[int]] = []
        if parts:
            # The line break becomes a letter that no pre-token holds.
            mapped = self.byte_level.pre_tokenize_str("\n".join(parts))[0][0].split("Ċ")
            tokenize = self.tokenizer.model.tokenize
            found += [[token.id for token in tokenize(part)] for part in mapped]
        found += [self.tokenizer.encode(word, add_special_tokens=False).ids for word in words]
        new = parts + words
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), "<u4")))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum([len(one) for one in found], dtype=np.int64)))
        # Ids take four bytes, and few words are of more ids than letters by four.
        self.size += sum(map(len, new)) * 3 + ENTRY_BYTES * len(new)

    def _numbered(self, parts: list[str], words: list[str]) -> np.ndarray:
        new = [[one for one in some if one not in self.numbers] for some in (parts, words)]
        if any(new):
            if self.size > CACHED_BYTES:
                self._clear()
                new = [[one for one in some if one] for some in (parts, words)]
            self._learn(*new)
        return np.fromiter(map(self.numbers.__getitem__, chain(parts, words)), np.int64, len(parts) + len(words))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.splits else np.ones(len(texts), bool)
        units, owner, plain = texts, np.arange(len(texts)), np.ones(len(texts), bool)
        if odd.any():
            # Of a text with other letters each word is a unit of its own, all other texts are units as a whole.
            lists = pc.ascii_split_whitespace(texts.filter(pa.array(odd)))
            words, sizes = lists.flatten(), np.ones(len(texts), np.int64)
            sizes[odd] = pc.list_value_length(lists).to_numpy()
            owner = np.repeat(owner, sizes)
            places, is_word = np.zeros(len(owner), np.int64), odd[owner]
            places[~is_word] = np.arange(len(texts) - int(odd.sum()))
            places[is_word] = np.arange(len(words)) + len(texts) - int(odd.sum())
            units = pa.concat_arrays([texts.filter(pa.array(~odd)), words]).take(pa.array(places))
            plain = ~pc.match_substring_regex(units, _ODD).to_numpy(zero_copy_only=False) if self.splits else np.zeros(len(units), bool)
        spaced = pc.replace_substring_regex(pc.utf8_lower(units.filter(pa.array(plain))), _BETWEEN_LETTERS, r" \1 ")
        lists = pc.ascii_split_whitespace(spaced)
        parts, others = lists.flatten().dictionary_encode(), units.filter(pa.array(~plain)).dictionary_encode()
        numbers = self._numbered(parts.dictionary.to_pylist(), others.dictionary.to_pylist())
        sizes = np.ones(len(units), np.int64)
        sizes[plain] = pc.list_value_length(lists).to_numpy()
        own = np.repeat(plain, sizes)
        found = np.zeros(len(own), np.int64)
        found[own] = numbers[parts.indices.to_numpy()]
        found[~own] = numbers[len(parts.dictionary) + others.indices.to_numpy()]
        starts = self.starts[found]
        lengths = self.starts[found + 1] - starts
        ends = np.cumsum(lengths)
        places = np.repeat(starts - ends + lengths, lengths)
        places += np.arange(len(places))
        totals = np.bincount(np.repeat(owner, sizes), lengths, len(texts)).astype(np.int64)
        return self.ids[places], totals

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, sizes = self.encode_column(pa.array(texts, pa.binary()).cast(pa.string()))
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _splits_as_known(tokenizer: dict) -> bool:
    """Lower-cased Latin text is split by ``_SPLIT`` and then handed byte by byte to a BPE model."""
    normalizers = (tokenizer.get("normalizer") or {}).get("normalizers", [])
    steps = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [])
    white = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    return (
        normalizers == [{"type": "NFC"}, white, {"type": "Lowercase"}]
        and [{k: v for k, v in step.items() if k != "trim_offsets"} for step in steps] == [split, byte_level]
        and tokenizer["model"].get("type") == "BPE"
        and all(token["content"].startswith("<|") for token in tokenizer.get("added_tokens", []))
    )


def _worker_tokens(tokenizer_json: str) -> WordTokens:
    return held(zlib.crc32(tokenizer_json.encode()), lambda: WordTokens(tokenizer_json))


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file as text, which is sent to the executors; by default the public 49k word vocabulary."""
    import public_tokenizers

    return Path(path or public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, cut long, crc_before long, crc_after long"
)


def tokenized_pieces(documents: DataFrame, tokenizer_json: str) -> DataFrame:
    """Full windows and the rest of every document (doc_id, text), with the checksums of both halves of the rest."""
    ship_package(documents.sparkSession)
    frame = documents.select("doc_id", "text")
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(tokenizer_json)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for begin, stop in blocks(texts, BLOCK_BYTES):
                column = pc.fill_null(batch.column(1).slice(begin, stop - begin), "")
                ids, sizes = tokens.encode_column(column)
                ids = memoryview(np.insert(ids, np.cumsum(sizes), END_ID)).cast("B")
                rows, owner, low = [], [], 0
                for place, total in enumerate((sizes + 1).tolist(), begin):
                    for start in range(0, total, WINDOW):
                        length = min(WINDOW, total - start)
                        piece = ids[4 * (low + start) : 4 * (low + start + length)]
                        crc, bins = zlib.crc32(piece), -(-length // BIN)
                        # A hashed place that differs between copies, which else would fill one bin again.
                        cut = BIN * (1 + zlib.crc32(bytes(piece[-64:]) + start.to_bytes(8, "little"), crc ^ place) % (bins - 1)) if bins > 2 and length < WINDOW else None
                        halves = (cut, zlib.crc32(piece[: 4 * cut]), zlib.crc32(piece[4 * cut :])) if cut else (None,) * 3
                        rows.append((start, length, crc, total, *halves))
                        owner.append(place)
                    low += total
                columns = list(zip(*rows, strict=True))
                ids_of = batch.column(0).take(pa.array(owner, pa.int64()))
                names = [part.split()[0] for part in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(one, pa.int64()) for one in columns)], names=["doc_id", *names])
        give_back()

    return frame.mapInArrow(run, f"doc_id {kind}, {PIECES}")


@dataclass(frozen=True)
class Pattern:
    """``repeats`` sequences, each holding ``parts`` (bin, pieces of that bin)."""

    repeats: int
    parts: tuple


def combinations_of(total: int, depth: int = DEPTH) -> np.ndarray:
    """All non-increasing combinations of up to ``depth`` bins that add up to ``total``, padded with zeros."""
    if depth == 1:
        return np.array([[total]])
    out = [row + [0] * (depth - len(row)) for row in _partitions(total, depth, total)]
    return np.array(sorted(out, reverse=True))


def _partitions(total: int, depth: int, most: int) -> Iterator[list[int]]:
    if total == 0:
        yield []
    elif depth and total <= depth * most:
        for first in range(min(total, most), 0, -1):
            for rest in _partitions(total - first, depth - 1, first):
                yield [first, *rest]


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by an active set; the support is never larger than the number of rows."""
    columns = matrix.shape[1]
    x, used = np.zeros(columns), np.zeros(columns, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = matrix.T @ (target - matrix @ x)
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance or used.all() or used.sum() >= matrix.shape[0]:
            break
        used[best] = True
        while True:
            part = np.flatnonzero(used)
            trial = np.linalg.lstsq(matrix[:, part], target, rcond=None)[0]
            if trial.min() > 0:
                x[:] = 0
                x[part] = trial
                break
            below = trial <= 0
            step = float(np.min(x[part][below] / np.maximum(x[part][below] - trial[below], 1e-300)))
            x[part] += step * (trial - x[part])
            used[part[(x[part] <= tolerance) & below]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def solve(histogram: dict[int, int], bins: int, slack: int) -> list[Pattern]:
    """Patterns for pieces counted per bin (1 to ``bins``). With ``slack`` bins at most left empty in a sequence,
    pieces that fit no such sequence are in no pattern; with slack = bins all pieces are."""
    left = np.zeros(bins + 1, np.int64)
    for size, count in histogram.items():
        left[size] = count
    patterns: list[Pattern] = []

    def take(repeats: int, sizes: list[int]) -> None:
        parts = {size: sizes.count(size) for size in sizes}
        patterns.append(Pattern(repeats, tuple(sorted(parts.items(), reverse=True))))
        for size, times in parts.items():
            left[size] -= repeats * times

    shapes = [[size for size in row if size] for row in combinations_of(bins).tolist()]
    shapes = [row for row in shapes if all(left[size] for size in row)]
    if shapes:
        matrix = np.zeros((bins + 1, len(shapes)))
        for column, row in enumerate(shapes):
            for size in row:
                matrix[size, column] += 1
        scale = float(left.max())
        for column, amount in enumerate(np.floor(nnls(matrix, left / scale) * scale + 1e-6).astype(np.int64).tolist()):
            row = shapes[column]
            repeats = min([amount, *(int(left[size]) // row.count(size) for size in row)])
            if repeats > 0:
                take(repeats, row)
    # Greedy: the largest piece first, then always the largest that still fits; as often as the counts allow.
    skipped = np.zeros(bins + 1, bool)
    while True:
        open_bins = np.flatnonzero((left > 0) & ~skipped)
        if not len(open_bins):
            break
        sizes, room = [int(open_bins[-1])], bins - int(open_bins[-1])
        spare = left.copy()
        spare[sizes[0]] -= 1
        while room:
            fitting = np.flatnonzero(spare[1 : room + 1] > 0)
            if not len(fitting):
                break
            size = int(fitting[-1]) + 1
            times = min(room // size, int(spare[size]))
            sizes += [size] * times
            spare[size] -= times
            room -= size * times
        if room > slack:
            skipped[sizes[0]] = True
            continue
        take(min(int(left[size]) // sizes.count(size) for size in set(sizes)), sizes)
    return patterns


def _ranked(pieces: DataFrame) -> DataFrame:
    """Number from 0 inside the bin: ranked in hashed groups, shifted by the sizes of the groups before."""
    total = pieces.count()
    groups = max(1, min(RANK_GROUPS, -(-total // RANKED)))
    dealt = materialize(
        pieces.withColumn("bin", F.ceil(F.col("length") / F.lit(BIN)).cast("int")).withColumn(
            "deal", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32", F.rand(11)), F.lit(groups)).cast("int")
        ),
        "pack-dealt",
    )
    sizes = dealt.groupBy("bin", "deal").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("bin").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("bin", "deal", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("bin", "deal").orderBy("doc_id", "start", "length", "ids_crc32")
    numbered = dealt.withColumn("inside", F.row_number().over(inside))
    joined = numbered.join(shifts, ["bin", "deal"]).withColumn("rank", F.col("shift") + F.col("inside") - 1)
    return materialize(joined.drop("deal", "inside", "shift"), "pack-ranked")


def _assign(ranked: DataFrame, slack: int, first_sequence: int) -> tuple[DataFrame, DataFrame, int]:
    """Pieces with sequence_id and slot; pieces in no pattern; the next free sequence."""
    spark, bins = ranked.sparkSession, WINDOW // BIN
    histogram = {row["bin"]: row["n"] for row in ranked.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    used, rows, sequence = dict.fromkeys(histogram, 0), [], first_sequence
    for pattern in solve(histogram, bins, slack):
        for slot, (size, times) in enumerate(pattern.parts):
            rows.append((size, used[size], used[size] + pattern.repeats * times, sequence, pattern.repeats, slot))
            used[size] += pattern.repeats * times
        sequence += pattern.repeats
    plan = spark.createDataFrame(rows, "bin int, low long, high long, base long, repeats long, slot long")
    ends = spark.createDataFrame(list(used.items()), "bin int, used long")
    # Both have a row or a few per bin and pattern, and there are no more bins than WINDOW / BIN.
    placed = ranked.join(F.broadcast(plan), "bin").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("base") + F.pmod(step, F.col("repeats")))
    placed = placed.withColumn("turn", F.expr("(rank - low) div repeats")).drop("low", "high", "base", "repeats", "bin", "rank")
    rest = ranked.join(F.broadcast(ends), "bin").filter(F.col("rank") >= F.col("used")).drop("bin", "rank", "used")
    return placed, rest, sequence


def _halved(rest: DataFrame) -> DataFrame:
    """Pieces with a cut become two."""
    none = F.lit(None).cast("long")
    own = [F.col(name) for name in ("start", "length", "ids_crc32")]
    before = [F.col("start"), F.col("cut"), F.col("crc_before")]
    after = [F.col("start") + F.col("cut"), F.col("length") - F.col("cut"), F.col("crc_after")]
    parts = [F.struct(*(c.alias(n) for c, n in zip(p, ("start", "length", "ids_crc32"), strict=True))) for p in (own, before, after)]
    chosen = F.when(F.col("cut").isNull(), F.array(parts[0])).otherwise(F.array(parts[1], parts[2]))
    split = rest.select("doc_id", "doc_tokens", F.explode(chosen).alias("part")).select("doc_id", "doc_tokens", "part.*")
    return split.withColumns({"cut": none, "crc_before": none, "crc_after": none})


def pack(documents: DataFrame, tokenizer_json: str) -> DataFrame:
    """Pieces of all documents in sequences of at most WINDOW tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is one piece that
    holds the end id only. Repeated rows are documents of their own, a null doc_id is kept; pieces of one length are
    ranked by doc_id and start. An empty table has no pieces. Extra columns are ignored.
    """
    ranked = _ranked(materialize(tokenized_pieces(documents, tokenizer_json), "pack-pieces"))
    first, rest, sequence = _assign(ranked, SLACK, 0)
    second, _, _ = _assign(_ranked(_halved(rest)), WINDOW // BIN, sequence)
    placed = first.unionByName(second)
    before = Window.partitionBy("sequence_id").orderBy("slot", "turn", "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )
