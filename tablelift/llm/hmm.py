"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled forward steps.

Symbols are the frequent words, a bounded number of classes for all other words, and the end of a text. A state
emits a symbol; a class emits its word by that word's count inside the class, so probabilities of all words, known
or not, add up to one. Counts of words cover all training texts and stay a table; only the frequent words and one
number per class or symbol reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelift.llm.text import blocks, give_back, held, ship_package
from tablelift.session import materialize, small_batches

#: Latent states, most frequent words that are symbols of their own, classes of the other words.
STATES, FREQUENT, CLASSES = 12, 1 << 16, 512
#: Baum-Welch rounds over all training texts, after the one that draws a state for each of them.
ROUNDS = 4
#: Symbols of a chain that Baum-Welch works on. Longer texts are several chains there, all of which count; scores take texts whole.
CHAIN = 256
#: Pull of transitions towards staying, in counts.
STAY = 5.0
#: Bytes of text, or of four-byte symbols, whose chains run in step; distinct words that a task counts before it hands them on.
BLOCK, COUNTED = 1_500_000, 500_000
#: Steps between two scalings of forward values. A step of probability 1e-30 in every state would still be told from zero.
SCALED = 8

_KEY = "_row"


def word_class(word: bytes) -> int:
    """Class of a word by its ending."""
    return zlib.crc32(word[-3:]) % CLASSES


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of a string column, the place there of every word of all texts end to end, words of each text.

    Arrow's ASCII functions know the letters A-Z and the six blanks that ``bytes.lower`` and ``bytes.split`` know.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    encoded = split.flatten().dictionary_encode()
    words, codes = encoded.dictionary.view(_binary(encoded.dictionary.type)).cast(pa.binary()), encoded.indices.to_numpy()
    # Blanks at the ends of a text leave an empty word there.
    real = codes != pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    sizes = np.bincount(pc.list_parent_indices(split).to_numpy()[real], minlength=len(texts))
    return words, codes[real], sizes


def _binary(kind: pa.DataType) -> pa.DataType:
    return pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()


def _ranges(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of a string column of about BLOCK bytes."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)


def count_words(training: DataFrame) -> DataFrame:
    """(word, class, c) over all texts; c of the empty word counts the ends."""
    ship_package(training.sparkSession)
    small_batches(training.sparkSession)

    def summed(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return found.rename_columns({"c_sum": "c"}).select(["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in batches:
            for a, b in _ranges(batch.column(0)):
                words, codes, sizes = tokens_of(batch.column(0).slice(a, b - a))
                counts = np.bincount(codes, minlength=len(words))
                met = pa.table({"word": words, "c": pa.array(counts, pa.int64())}).filter(pa.array(counts > 0))
                ends = pa.table({"word": pa.array([b""], pa.binary()), "c": pa.array([len(sizes)], pa.int64())})
                parts += [met, ends]
                if sum(part.num_rows for part in parts) > 2 * COUNTED:
                    parts = [summed(parts)]
                    if parts[0].num_rows > COUNTED:
                        yield from parts.pop().to_batches(COUNTED // 5)
        if parts:
            yield from summed(parts).to_batches(COUNTED // 5)
        parts.clear()
        give_back()

    found = training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return found.select("word", (F.crc32(F.substring("word", -3, 3)) % CLASSES).cast("int").alias("class"), "c")


@dataclass(frozen=True)
class Lexicon:
    """words: frequent words with counts; class_total: count + distinct + 1 per class; totals over all training tokens."""

    key: str
    words: list
    counts: np.ndarray
    class_total: np.ndarray
    tokens: int
    distinct: int
    ends: int
    least: int

    @property
    def symbols(self) -> int:
        return len(self.words) + CLASSES + 1

    def shares(self) -> np.ndarray:
        """Share of every symbol, never zero."""
        mass = np.concatenate((self.counts, self.class_total, [self.ends + 1])).astype(float)
        return mass / mass.sum()


def lexicon(counts: DataFrame, frequent: int = FREQUENT) -> Lexicon:
    """Frequent words and totals. The least count is found on a histogram of counts, so that no sort is needed."""
    words = counts.filter(F.length("word") > 0)
    level = F.floor(F.log2("c") * 8).cast("int")
    ladder = sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda row: -row["level"])
    seen, lowest = 0, None
    for row in ladder:
        seen += row["n"]
        if seen > frequent:
            break
        lowest = row["level"]
    least = math.ceil(2 ** (lowest / 8) - 1e-9) if lowest is not None else 1 << 62
    top = sorted((bytes(row["word"]), row["c"]) for row in words.filter(F.col("c") >= least).select("word", "c").toLocalIterator())
    rare = words.filter(F.col("c") < least).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    class_total = np.ones(CLASSES, np.int64)
    for row in rare.collect():
        class_total[row["class"]] += row["c"] + row["v"]
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    key = f"{counts.sparkSession.sparkContext.applicationId}-{len(top)}-{tokens}-{distinct}-{zlib.crc32(b' '.join(w for w, _ in top))}"
    return Lexicon(key, [w for w, _ in top], np.array([c for _, c in top], np.int64), class_total, tokens, distinct, ends, least)


def _known(lexicon_: Lexicon) -> pa.Array:
    """Frequent words as a column, built once per worker and lexicon."""
    return held(lexicon_.key, lambda: pa.array(lexicon_.words, pa.binary()))


def symbols_of(lexicon_: Lexicon, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Symbols of all texts end to end, their numbers, and each text's different words that are not frequent, counted."""
    base = len(lexicon_.words)
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.binary()).view(pa.string())
    words, codes, sizes = tokens_of(texts)
    places = pc.index_in(words, value_set=_known(lexicon_)).fill_null(-1).to_numpy().astype(np.int32)
    other = np.flatnonzero(places < 0)
    endings = pc.binary_slice(words.take(pa.array(other)), -3).dictionary_encode()
    places[other] = base + np.array([word_class(ending) for ending in endings.dictionary.to_pylist()], np.int32)[endings.indices.to_numpy()]
    ends = np.cumsum(sizes + 1) - 1
    is_word = np.ones(len(codes) + len(sizes), bool)
    is_word[ends] = False
    ids = np.full(len(is_word), base + CLASSES, np.int32)
    ids[is_word] = places[codes]
    is_rare = places[codes] >= base
    owners = np.repeat(np.arange(len(sizes)), sizes)[is_rare]
    pairs, n = np.unique(owners * max(1, len(words)) + codes[is_rare], return_counts=True)
    owners, codes = np.divmod(pairs, max(1, len(words)))
    rare = pa.StructArray.from_arrays([words.take(pa.array(codes)), pa.array(n, pa.int32())], names=["word", "n"])
    firsts = np.searchsorted(owners, np.arange(len(sizes) + 1))
    return ids, sizes + 1, pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), rare)


@dataclass(frozen=True)
class Hmm:
    """start (states), move (states x states), emit (symbols x states): probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of chains laid end to end, ordered by step; the chains alive at a step; their offsets.

    Chains are sorted by length, so those that reach a step are a prefix of those of the step before.
    """
    order = np.argsort(-sizes, kind="stable")
    firsts, longest = (np.cumsum(sizes) - sizes)[order], int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    offsets = np.concatenate(([0], np.cumsum(alive)))
    rows = np.repeat(np.arange(longest), alive)
    rows += firsts[np.arange(len(rows)) - np.repeat(offsets[:-1], alive)]
    return rows, alive, offsets


def forward(model: Hmm, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Natural log likelihood of every chain; forward values and the layout, for the backward steps.

    Values are scaled at every step that is a multiple of SCALED, and taken as they are in between. No chain is empty.
    """
    rows, alive, offsets = _steps(sizes)
    symbols = ids[rows].astype(np.intp)
    values = model.emit.take(symbols, axis=0)
    order = np.argsort(-sizes, kind="stable")
    found, totals, ones = np.zeros(len(sizes)), {}, np.ones(len(model.start))
    for t in range(len(alive)):
        now = values[offsets[t] : offsets[t + 1]]
        if t:
            now *= values[offsets[t - 1] : offsets[t - 1] + alive[t]] @ model.move
        else:
            now *= model.start
        if t % SCALED == 0:
            totals[t] = now @ ones
            now /= totals[t][:, None]
            found[: alive[t]] += np.log(totals[t])
    ends = offsets[sizes[order] - 1] + np.arange(len(order))
    last = values[ends] @ ones
    logs = np.empty(len(sizes))
    logs[order] = found + np.log(last)
    return logs, values, (symbols, alive, offsets, totals, ends, last)


def expected(model: Hmm, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions (symbols x states) of the chains."""
    _, alpha, (symbols, alive, offsets, totals, ends, last) = forward(model, ids, sizes)
    states = len(model.start)
    tails, beta, move = model.emit.take(symbols, axis=0), np.empty_like(alpha), np.zeros((states, states))
    beta[ends] = 1.0 / last[:, None]
    back = np.ascontiguousarray(model.move.T)
    for t in range(len(alive) - 1, 0, -1):
        a, b, before = offsets[t], offsets[t + 1], offsets[t - 1]
        tail = tails[a:b]
        tail *= beta[a:b]
        if t in totals:
            tail /= totals[t][:, None]
        beta[before : before + alive[t]] = tail @ back
        move += alpha[before : before + alive[t]].T @ tail
    alpha *= beta
    del tails, beta
    starts = alpha[: alive[0]].sum(axis=0) if len(alive) else np.zeros(states)
    emit = np.stack([np.bincount(symbols, one, len(model.emit)) for one in np.ascontiguousarray(alpha.T)], axis=1)
    return starts, move * model.move, emit


def maximised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Hmm:
    """Probabilities from expected counts; nothing is impossible.

    A state's emissions are pulled towards the overall shares by as many counts as it has different symbols
    (Witten and Bell), so that a state of few tokens trusts the shares and one of many trusts itself.
    """
    states = len(start)
    start = start + 1.0
    move = move + STAY * np.eye(states) + 0.1
    emit = emit + (np.minimum(emit, 1.0).sum(axis=0) + 1.0) * shares[:, None]
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def leaning(ids: list[bytes], lexicon_: Lexicon, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the first round: every text leans towards states drawn by a hash of its symbols, so copies lean alike."""
    sizes = np.array([len(one) // 4 for one in ids], np.int64)
    lean = [np.random.default_rng(zlib.crc32(one)).dirichlet(np.full(states, 0.3)) for one in ids]
    symbols, shares = np.frombuffer(b"".join(ids), np.int32).astype(np.intp), np.array(lean).reshape(-1, states).T
    emit = np.stack([np.bincount(symbols, np.repeat(share, sizes), lexicon_.symbols) for share in shares], axis=1)
    return np.zeros(states), np.zeros((states, states)), emit


ENCODED = "ids binary, rare array<struct<word: binary, n: int>>"


def encode(documents: DataFrame, lexicon_: Lexicon) -> DataFrame:
    """Symbols of every whole text and its words that are not frequent, with all columns but text, written once.

    Words are looked up here and nowhere else: rounds and scores read the symbols.
    """
    spark = documents.sparkSession
    ship_package(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon_)
    kept = [name for name in documents.columns if name != "text"]
    head = "".join(f"`{name}` {documents.schema[name].dataType.simpleString()}, " for name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for a, b in _ranges(texts):
                ids, sizes, rare = symbols_of(shared.value, texts.slice(a, b - a))
                cuts = pa.py_buffer(np.concatenate(([0], np.cumsum(4 * sizes))).astype(np.int32))
                columns = [batch.column(batch.schema.get_field_index(name)).slice(a, b - a) for name in kept]
                columns += [pa.Array.from_buffers(pa.binary(), len(sizes), [None, cuts, pa.py_buffer(ids)]), rare]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", "rare"])
        give_back()

    return materialize(documents.mapInArrow(run, head + ENCODED), "hmm-symbols")


def _chains(ids: list[bytes]) -> np.ndarray:
    """Sizes of the chains that texts are cut into. Steps run as long as the longest chain of a block."""
    sizes = np.array([len(one) // 4 for one in ids], np.int64)
    whole = np.maximum(1, -(-sizes // CHAIN))
    chains = np.full(int(whole.sum()), CHAIN, np.int64)
    chains[np.cumsum(whole) - 1] = sizes - (whole - 1) * CHAIN
    return chains


def baum_welch(encoded: DataFrame, lexicon_: Lexicon, model: Hmm | None, states: int = STATES) -> Hmm:
    """One round over the symbols (ids) of all training texts, in chains: every task sums its expected counts, Spark
    sums the tasks' rows. Without a model it is the round that draws the states."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((lexicon_, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_lexicon, own = shared.value
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((own_lexicon.symbols, states))]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b in blocks(ids, BLOCK):
                if own is None:
                    parts = leaning(ids[a:b], own_lexicon, states)
                else:
                    parts = expected(own, np.frombuffer(b"".join(ids[a:b]), np.int32), _chains(ids[a:b]))
                for total, part in zip(sums, parts, strict=True):
                    total += part
        every = np.vstack((sums[2], sums[1], sums[0][None, :]))
        places = np.flatnonzero(every.any(axis=1))
        columns = [pa.array(places, pa.int64()), *(pa.array(every[places, k]) for k in range(states))]
        yield pa.RecordBatch.from_arrays(columns, names=["place", *(f"s{k}" for k in range(states))])
        give_back()

    schema = "place long, " + ", ".join(f"s{k} double" for k in range(states))
    found = encoded.select("ids").mapInArrow(run, schema)
    # One row per symbol and state number, whatever the number of texts.
    sums = found.groupBy("place").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states)))
    every = np.zeros((lexicon_.symbols + states + 1, states))
    table = sums.toArrow()
    if table.num_rows:
        every[table["place"].to_numpy()] = np.column_stack([table[f"s{k}"].to_numpy() for k in range(states)])
    shared.unpersist()
    if model is None:
        every[lexicon_.symbols : -1] += 50.0 * np.eye(states)
    return maximised(every[-1], every[lexicon_.symbols : -1], every[: lexicon_.symbols], lexicon_.shares())


def fit(encoded: DataFrame, lexicon_: Lexicon, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """All rounds, the first included, over the symbols of all training texts."""
    model = baum_welch(encoded, lexicon_, None, states)
    for _ in range(rounds):
        model = baum_welch(encoded, lexicon_, model, states)
    return model


def counted(training: DataFrame) -> tuple[DataFrame, Lexicon]:
    """Word counts (a table) and lexicon of the texts of ``training`` (text)."""
    counts = materialize(count_words(training), "hmm-counts")
    return counts, lexicon(counts)


def learn(training: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Lexicon, Hmm]:
    """Word counts (a table), lexicon and model of the texts of ``training`` (text)."""
    counts, lexicon_ = counted(training)
    return counts, lexicon_, fit(encode(training.select("text"), lexicon_), lexicon_, rounds)


def learn_and_score(documents: DataFrame, is_training: Column) -> DataFrame:
    """``score_texts`` of all documents by a model of those that are for training; every text is looked up once."""
    counts, lexicon_ = counted(documents.filter(is_training).select("text"))
    encoded = encode(_keyed(documents).withColumn("_trains", is_training), lexicon_)
    return _scores(encoded.drop("_trains"), counts, lexicon_, fit(encoded.filter("_trains"), lexicon_))


SCORED = "n_tokens long, n_frequent long, base_part double, score_part double"


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn(_KEY, F.monotonically_increasing_id())


def score_texts(documents: DataFrame, counts: DataFrame, lexicon_: Lexicon, model: Hmm) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text, with all columns but text.

    A null or empty text is its end alone. Without training tokens every token has base probability 1. Repeated rows
    repeat, a null doc_id is kept. Words that are not frequent meet their counts in a join, summed by row again.
    """
    return _scores(encode(_keyed(documents), lexicon_), counts, lexicon_, model)


def _scores(encoded: DataFrame, counts: DataFrame, lexicon_: Lexicon, model: Hmm) -> DataFrame:
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((lexicon_, model))
    kept = [name for name in encoded.columns if name not in ("ids", "rare", _KEY)]
    head = ", ".join(f"`{name}` {encoded.schema[name].dataType.simpleString()}" for name in [*kept, _KEY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trained = shared.value
        base = math.log10(own.tokens + own.distinct + 1)
        known = np.concatenate((np.log10(own.counts + 1.0), np.zeros(CLASSES), [math.log10(own.ends + 1)])) - base
        inside = -np.log10(own.class_total)
        for batch in batches:
            every = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            for a, b in blocks(every, BLOCK):
                ids, sizes = np.frombuffer(b"".join(every[a:b]), np.int32), np.array([len(one) // 4 for one in every[a:b]], np.int64)
                logs, _, _ = forward(trained, ids, sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                classes = ids - len(own.words)
                is_rare = (classes >= 0) & (classes < CLASSES)
                score = logs / math.log(10) + np.bincount(owner[is_rare], inside[classes[is_rare]], len(sizes))
                part = batch.slice(a, b - a)
                columns = [part.column(part.schema.get_field_index(name)) for name in [*kept, _KEY]]
                columns += [
                    pa.array(sizes),
                    pa.array(sizes - np.bincount(owner[is_rare], minlength=len(sizes)) - (own.ends == 0)),
                    pa.array(np.bincount(owner, known[ids], len(sizes))),
                    pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, _KEY, *(one.split()[0] for one in SCORED.split(", "))])
        give_back()

    parts = encoded.select(*kept, _KEY, "ids").mapInArrow(run, f"{head}, {SCORED}")
    words = encoded.select(_KEY, F.explode("rare").alias("one")).select(_KEY, "one.word", "one.n")
    rare = counts.filter(F.col("c") < lexicon_.least).select("word", "c")
    met = words.join(rare, "word").groupBy(_KEY).agg(
        F.sum("n").alias("_seen"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_logs")
    )
    seen, logs = F.coalesce("_seen", F.lit(0)), F.coalesce("_logs", F.lit(0.0))
    return parts.join(met, _KEY, "left").select(
        *kept,
        "n_tokens",
        (F.col("n_frequent") + seen).cast("long").alias("n_known"),
        F.lit(lexicon_.tokens).cast("long").alias("train_tokens"),
        (F.col("base_part") + logs).alias("base_score"),
        (F.col("score_part") + logs).alias("score"),
    )
