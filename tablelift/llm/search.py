"""Exact top-k search of vectors, term at a time.

Components are whole numbers; a vector is a sparse row of (term, weight), its terms the places of non-zero components.
Candidates are dealt into blocks of bounded size by a row number, queries too. Every block of queries meets every block
of candidates in one task: postings (row, weight) are laid out per term, a query row scatters its weight times the
postings' weights into a dense array of scores, and a partition of that array selects the best. Blocks hand on at most
``k`` rows per query, which are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelift.llm.text import ship_package
from tablelift.session import materialize

#: Candidates and queries that meet in one task, and the components that either may hold (so 64 MB as numbers).
CANDIDATES, QUERIES, COMPONENTS = 1 << 14, 1 << 13, 1 << 23
#: Candidates whose scores stand in one dense array.
TILE = 8192
#: Components are clipped to what a long holds.
_LARGEST = float(1 << 62)
#: A posting list of more than this share of a tile is stored dense.
_DENSE = 0.125


def quantized(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of all components, and where each vector starts."""
    if not len(vectors):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * flat), -_LARGEST, _LARGEST).astype(np.int64), offsets - offsets[0]


def _number_type(queries: np.ndarray, candidates: np.ndarray, width: int) -> type:
    """The smallest kind of number that no sum of ``width`` products leaves."""
    largest = [int(max(abs(int(x.min())), abs(int(x.max())))) if len(x) else 0 for x in (queries, candidates)]
    bound = largest[0] * largest[1] * max(1, width)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def _postings(values: np.ndarray, offsets: np.ndarray, kind: type) -> list[tuple]:
    """Per term the rows that hold it, or None for a list as long as the tile, and their weights."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    held = values != 0
    row, term, weight = row[held], term[held], values[held]
    order = np.argsort(term, kind="stable")
    row, weight = row[order], weight[order]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=int(sizes.max(initial=0))))))
    out: list[tuple] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > _DENSE * len(sizes):
            dense = np.zeros(len(sizes), kind)
            dense[row[a:b]] = weight[a:b].astype(kind)
            out.append((None, dense))
        else:
            out.append((row[a:b], weight[a:b].astype(kind)))
    return out


def best_of_block(query: tuple, query_rows: np.ndarray, candidate: tuple, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(place of the query, place of the candidate, score) of the ``k`` best candidates of each query.

    ``query`` and ``candidate`` are (components, starts). A candidate of the query's own row number is left out.
    Of equal scores the candidate that stands first wins.
    """
    (query_values, query_offsets), (values, offsets) = query, candidate
    width = min(int(np.diff(query_offsets).max(initial=0)), int(np.diff(offsets).max(initial=0)))
    kind = _number_type(query_values, values, width)
    number = len(query_rows)
    terms = []
    for a, b in zip(query_offsets[:-1].tolist(), query_offsets[1:].tolist(), strict=True):
        one = query_values[a:b]
        held = np.flatnonzero(one)
        terms.append(list(zip(held.tolist(), one[held].astype(kind), strict=True)))
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, kind))] * number
    for low in range(0, len(rows), TILE):
        high = min(len(rows), low + TILE)
        postings = _postings(values[offsets[low] : offsets[high]], offsets[low : high + 1], kind)
        score, product = np.zeros(high - low, kind), np.empty(high - low, kind)
        for place, sparse in enumerate(terms):
            score[:] = 0
            for term, weight in sparse:
                if term >= len(postings):
                    break
                row, weights = postings[term]
                if row is None:
                    np.multiply(weights, weight, out=product)
                    np.add(score, product, out=score)
                elif len(row):
                    score[row] += weights * weight
            old, old_scores = best[place]
            if len(old) == k:
                # Candidates of later tiles lose ties.
                hits = np.flatnonzero(score > old_scores[-1])
            elif k + 1 < len(score):
                hits = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
            else:
                hits = np.arange(len(score))
            hits = hits[rows[hits + low] != query_rows[place]]
            if len(hits):
                both = np.concatenate((old, hits + low))
                scores = np.concatenate((old_scores, score[hits]))
                order = np.argsort(-scores, kind="stable")[:k]
                best[place] = both[order], scores[order]
    counts = [len(one) for one, _ in best]
    limit = (1 << 63) - 1
    chosen = np.concatenate([scores for _, scores in best]) if number else np.empty(0, np.int64)
    if kind is object:
        chosen = np.array([max(-limit - 1, min(limit, one)) for one in chosen], np.int64)
    return np.repeat(np.arange(number), counts), np.concatenate([one for one, _ in best]) if number else chosen, chosen.astype(np.int64)


def _dealt(numbered: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Rows with a block number each, so that a block holds at most about ``most`` rows and COMPONENTS components."""
    rows, components = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    number = max(1, -(-rows // most), -(-components // COMPONENTS))
    return numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(number)).cast("int")), number


def top_k(vectors: DataFrame, is_query: F.Column, k: int, id_: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of highest inner product with each query row, exactly: query_id, rank, vec_id, score.

    Components x count as floor(scale * x). Rows for which ``is_query`` holds are queries; every other row is a
    candidate of theirs, queries too. Equal scores are ranked by ascending id, null ids last, then in row order. Vectors
    that are null or hold a null or non-finite component take no part. Missing components of a shorter or empty vector
    count as zero. Repeated rows, and rows that share an id, are queries and candidates of their own. Scores beyond a
    long are held to its limits. A query has fewer rows if there are fewer candidates; an empty table gives none.
    Other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    frame = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"), usable.alias("usable"))
    # Row numbers tell rows of one id apart; a third of all rows under one id are dealt out like any others.
    frame = frame.filter(F.col("vector").isNotNull() & F.col("usable")).select("id", "vector", "asks", F.monotonically_increasing_id().alias("row"))
    frame = materialize(frame, "search-rows")
    kind = frame.schema["id"].dataType.simpleString()
    candidates, blocks = _dealt(frame.drop("asks"), CANDIDATES)
    queries, query_blocks = _dealt(frame.filter("asks").drop("asks"), QUERIES)
    # Each block of queries meets each block of candidates once, so a row is copied as often as the other side has blocks.
    keys = ["block", "query_block"]
    left = queries.withColumnRenamed("block", "query_block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def meet(asked: pa.Table, given: pa.Table) -> pa.Table:
        given = given.sort_by([("id", "ascending"), ("row", "ascending")])
        asked, given = asked.combine_chunks(), given.combine_chunks()
        sides = []
        for side in (asked, given):
            column = side["vector"]
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
            sides.append((quantized(column, scale), side["row"].to_numpy()))
        (query, query_rows), (candidate, rows) = sides
        a, b, score = best_of_block(query, query_rows, candidate, rows, k)
        return pa.table({
            "query_row": pa.array(query_rows[a]), "query_id": asked["id"].take(pa.array(a)),
            "row": pa.array(rows[b]), "id": given["id"].take(pa.array(b)), "score": pa.array(score),
        })

    schema = f"query_row long, query_id {kind}, row long, id {kind}, score long"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_), "score")


#: ``op12_search`` in SQL: each query against all rows, component by component.
SQL = """
WITH vectors AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
terms AS (SELECT vec_id, unnest(generate_series(1, len(v))) AS term, unnest(v) AS weight FROM vectors),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.weight * c.weight) AS BIGINT) AS score
    FROM terms q JOIN terms c ON q.term = c.term AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
