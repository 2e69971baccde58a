"""Ranked lexical search by the Best Position Algorithm.

All documents are read once for the terms of the items: their number of words and how often they hold each term. Counts
over all documents then give each term its weight and each (term, document) its impact. Documents are dealt into shards
of bounded size. A shard holds one list per term, by falling impact, and answers every item for itself:

Lists of the item's terms are read in parallel. A document met for the first time is looked up in all other lists at
once (direct access), which gives its whole score and marks its positions there as seen. The best position of a list is
the last one up to which all have been seen, by reading or by direct access. No document that was not met scores more
than the impacts at the best positions together, a bound that is never above that of the last positions read. A shard
stops as soon as the bound lies strictly below the score of the k-th best, so that all of equal score have been met.
The shards' best documents are merged by rank.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelift.llm.text import as_bytes, blocks, release, ship_package
from tablelift.session import materialize

#: Bytes of item text that are searched at once; more items are searched part by part.
PART_BYTES = 8_000_000
#: Postings of a shard.
SHARD = 1 << 20
#: The fewest and most positions of each list that are read before the bound is looked at again.
STEP, LONGEST_STEP = 4, 1024

#: ASCII capitals become small, bytes that end a term become blanks; all bytes of other letters stay.
_TERMS = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32
    for byte in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal matches of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_TERMS).split()


def term_counts(documents: DataFrame, vocabulary: list[bytes], id_: str) -> DataFrame:
    """row, id, number of terms, and the terms of ``vocabulary`` (by number) in every document with their counts."""
    frame = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_).alias("id"), "text")
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = {term: k for k, term in enumerate(vocabulary)}
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for begin, end in blocks(texts):
                sizes, counts = [], []
                for text in texts[begin:end]:
                    words = terms_of(text)
                    sizes.append(len(words))
                    counts.append(Counter(filter(number.__contains__, words)))
                offsets = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                terms = np.fromiter((number[term] for one in counts for term in one), np.int32)
                times = np.fromiter((count for one in counts for count in one.values()), np.int32)
                columns = [pa.ListArray.from_arrays(offsets, pa.array(one)) for one in (terms, times)]
                columns = [*(batch.column(k).slice(begin, end - begin) for k in (0, 1)), pa.array(sizes, pa.int64()), *columns]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n", "terms", "times"])

    return frame.mapInArrow(run, f"row long, id {kind}, n long, terms array<int>, times array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Impact lists of the terms of some documents, and each document's entries in them for direct access."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int) -> None:
        self.offsets, self.terms, self.impacts = offsets, terms, impacts
        documents = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.lexsort((documents, -impacts, terms))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=vocabulary))))
        self.list_documents, self.list_impacts = documents[order], impacts[order]
        #: Of each entry its position in its term's list.
        self.positions = np.empty(len(terms), np.int64)
        self.positions[order] = np.arange(len(terms)) - self.starts[terms[order]]
        self.met = np.zeros(len(offsets) - 1, np.int64)
        self.turn = 0
        self.repeats = np.zeros(vocabulary, np.int64)
        self.shift = np.zeros(vocabulary, np.int64)
        #: Positions seen by the last search, in all its lists together.
        self.seen_positions = 0

    def _looked_up(self, documents: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Whole scores of ``documents``; their positions in the item's lists are marked as seen."""
        begin, sizes = self.offsets[documents], self.offsets[documents + 1] - self.offsets[documents]
        ends = np.cumsum(sizes)
        entry = np.arange(ends[-1]) + np.repeat(begin - ends + sizes, sizes)
        terms = self.terms[entry]
        repeats = self.repeats[terms]
        sums = np.concatenate(([0], np.cumsum(repeats * self.impacts[entry])))
        hit = repeats > 0
        seen[self.shift[terms[hit]] + self.positions[entry[hit]]] = True
        return sums[ends] - sums[ends - sizes]

    def best(self, item: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` documents of highest score above 0 for an item (term: repeats) and their scores; of equal
        scores the first documents."""
        terms = np.array([term for term in item if self.starts[term + 1] > self.starts[term]], np.int64)
        none = np.empty(0, np.int64)
        if not len(terms):
            return none, none
        repeats = np.array([item[term] for term in terms.tolist()], np.int64)
        starts, sizes = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        shift = np.cumsum(sizes) - sizes
        self.repeats[terms], self.shift[terms] = repeats, shift
        seen = np.zeros(int(sizes.sum()), bool)
        self.turn += 1
        best = np.zeros(len(terms), np.int64)
        documents, scores, top, step = [], [], none, STEP
        while True:
            ends = np.minimum(best + step, sizes)
            read = np.concatenate([self.list_documents[a + b : a + c] for a, b, c in zip(starts.tolist(), best.tolist(), ends.tolist(), strict=True)])
            fresh = np.unique(read[self.met[read] != self.turn])
            if len(fresh):
                self.met[fresh] = self.turn
                found = self._looked_up(fresh, seen)
                documents.append(fresh)
                scores.append(found)
                top = np.concatenate((top, found))
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[len(top) - k :]
            for place in np.flatnonzero(best < sizes).tolist():
                rest = seen[shift[place] + best[place] : shift[place] + sizes[place]]
                gap = int(rest.argmin())
                best[place] = sizes[place] if rest[gap] else best[place] + gap
            unread = best < sizes
            # What was not met stands behind the best position of a list, or nowhere in a list seen as a whole.
            bound = int((repeats[unread] * self.list_impacts[starts[unread] + best[unread] - 1]).sum())
            if not unread.any() or (len(top) == k and bound < top.min()):
                break
            step = min(2 * step, LONGEST_STEP)
        self.repeats[terms] = 0
        self.seen_positions = int(seen.sum())
        all_documents, all_scores = np.concatenate(documents), np.concatenate(scores)
        keep = all_scores >= max(1, int(top.min()))
        all_documents, all_scores = all_documents[keep], all_scores[keep]
        order = np.lexsort((all_documents, -all_scores))[:k]
        return all_documents[order], all_scores[order]


def _parts(items: DataFrame, item_id: str) -> Iterator[list[tuple]]:
    """(id, term counts) of items, in parts of PART_BYTES of text or of one longer item."""
    part, size = [], 0
    for row in items.select(F.col(item_id).alias("id"), F.col("text").alias("text")).toLocalIterator():
        text = (row["text"] or "").encode()
        if part and size + len(text) > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((row["id"], Counter(terms_of(text))))
        size += len(text)
    if part:
        yield part


def _search(documents: DataFrame, part: list[tuple], k: int, id_: str, item_kind: str) -> DataFrame:
    vocabulary = sorted(set().union(*(counts for _, counts in part)))
    number = {term: place for place, term in enumerate(vocabulary)}
    items = [{number[term]: count for term, count in counts.items()} for _, counts in part]
    counted = materialize(term_counts(documents, vocabulary, id_), "ranking-terms")
    n_documents, length, postings = counted.agg(
        F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))
    ).first()
    # One row per term of the part, so no more than PART_BYTES allows.
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in holding.collect():
        weights[row["term"]] = weight(n_documents, row["documents"])
    shards = max(1, -(-postings // SHARD))
    dealt = counted.filter(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def answer(shard: pa.Table) -> pa.Table:
        # Documents stand by id, so that of equal scores the first is the smallest; null ids come last.
        shard = shard.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        terms, times = shard["terms"].chunk(0), shard["times"].chunk(0)
        offsets = terms.offsets.to_numpy().astype(np.int64)
        flat = slice(int(offsets[0]), int(offsets[-1]))
        term, tf = terms.values.to_numpy()[flat], times.values.to_numpy()[flat].astype(np.int64)
        offsets -= offsets[0]
        m = 75 + 25 * shard["n"].to_numpy() * n_documents // length
        impacts = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(offsets))))
        lists = Shard(offsets, term, impacts, len(vocabulary))
        places, found, scores = [], [], []
        for place, item in enumerate(items):
            one, score = lists.best({term: count for term, count in item.items() if weights[term] > 0}, k)
            places += [place] * len(one)
            found.append(one)
            scores.append(score)
        at = pa.array(np.concatenate(found))
        return pa.table({"item": pa.array(places, pa.int32()), "row": shard["row"].take(at), "id": shard["id"].take(at), "score": pa.array(np.concatenate(scores))})

    kind = counted.schema["id"].dataType.simpleString()
    best = dealt.groupBy("shard").applyInArrow(answer, f"item int, row long, id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = documents.sparkSession.createDataFrame([(place, one[0]) for place, one in enumerate(part)], f"item int, item_id {item_kind}")
    return ranked.join(names, "item").select("item_id", "rank", "id", "score")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 20, id_: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """The ``k`` documents of highest score above 0 for the text of each item: item_id, rank, the document's id, score.

    Equal scores are ranked by ascending id, null ids last, then in row order. A null or empty text has no terms:
    such a document is in no result and such an item has no rows. Repeated rows, and rows that share an id, are
    documents and items of their own. Empty tables give no rows. Columns other than ids and text are ignored.
    """
    ship_package(documents.sparkSession)
    kinds = items.schema[item_id].dataType.simpleString(), documents.schema[id_].dataType.simpleString()
    found = documents.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, id {kinds[1]}, score long")
    for part in _parts(items, item_id):
        found = found.unionByName(_search(documents, part, k, id_, kinds[0]))
    return found.withColumnsRenamed({"item_id": item_id, "id": id_})


#: ``op13_ranking`` in SQL: every document that holds a term is scored in full.
SQL = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
wanted AS (
    SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, whole GROUP BY term),
scores AS (
    SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
    FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
