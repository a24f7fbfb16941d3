"""Exact top-k search by inner product with MaxScore.

Components become integers, floor(scale * x). Each dimension is a term, with one posting list for the vectors
in which it is positive and one for those in which it is negative; a query meets the list of its own component's
sign, where the term adds to the score, and no entry adds more than the list's bound. Terms are put in the order
of their bounds. The weakest, whose bounds together stay under the k-th best score so far, are non-essential:
a vector found in no other list cannot get among the best. Essential lists are traversed and add up what they
hold; vectors that can still compete are then probed for non-essential terms, the strongest first, and leave as
soon as the bounds of those left cannot carry them to the k-th best. A vector with an equal score stays, since
ties go to the smaller id.

Vectors are dealt once to tasks by their id and written down; a task streams its vectors in shards of a bounded
size and keeps the k best of each query. The lists of all tasks are merged
by a window of k rows a task for each query. Queries are numbered exactly and travel in passes of at most
QUERY_BYTES, so neither a task nor the driver ever holds more of them, and each pass scans the vectors again.

Odd input: vectors that are null, or hold a null or a component that is not finite (before or after scaling),
take no part, nor do rows without id; an empty vector scores 0; a shorter vector has zeros for what it lacks; rows
that repeat are vectors of their own, but a query equal in id and vector is answered once, and a vector with the
query's id is not among its results; scores beyond 64 bits are computed exactly and reported as the nearest
64-bit number; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyclerk.operators.numbering import numbered

from .common import checkpointed

K, SCALE = 5, 256
#: Bytes of a shard's vectors, and of the queries of one pass, at 8 bytes a component.
SHARD_BYTES, QUERY_BYTES = 1 << 20, 16 << 20
#: Queries that traverse a shard together, and terms that are probed between two looks at the bounds.
TOGETHER, PROBES = 256, 4
#: Vectors of one task, where there are enough for all cores.
TASK_ROWS = 1 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integers(vectors: pa.ListArray, width: int, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale * x), zeros after the end; Python integers where 64 bits could be too few."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    whole = np.zeros((len(vectors), width), np.float64)
    whole[np.arange(width) < lengths[:, None]] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(whole).max(initial=0) < 2.0**53:
        return whole.astype(np.int64)
    return np.array([int(x) for x in whole.ravel()], dtype=object).reshape(whole.shape)


class Best:
    """The k best (score, id) so far: the highest scores, of equal ones the smallest ids."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int | None:
        """What a vector must score to get in; None while any does."""
        return int(self.score[-1]) if len(self.score) == self.k else None

    def put(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 8 * self.k:
            some = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[some], ids[some]
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        first = np.lexsort((ids, ~score))[: self.k]
        self.score, self.id = score[first], ids[first]


class Shard:
    """Vectors of some rows. Embeddings are dense, so a dimension's two posting lists are the positive and
    the negative entries of its column, and those of many queries are traversed together, as a product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.bound = np.stack([vectors.max(axis=0, initial=0), -vectors.min(axis=0, initial=0)])
        self.largest = int(self.bound.max(initial=0))

    def _kind(self, queries: np.ndarray, best: list[Best]) -> type:
        """Numbers in which all sums are exact."""
        most = self.largest * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        most = max([most, *(abs(b.least() or 0) for b in best)])
        return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object

    def search(self, queries: np.ndarray, owns: list[int], best: list[Best]) -> None:
        """Put into each query's `best` every vector that belongs there; `owns` are the ids of the queries."""
        if not len(self.ids) or not len(owns):
            return
        kind = self._kind(queries, best)
        vectors, queries, bound = (x.astype(kind) for x in (self.vectors, queries, self.bound))
        strength = np.where(queries < 0, -queries * bound[1], queries * bound[0])
        order = np.argsort(strength, axis=1, kind="stable")
        upto = np.cumsum(np.take_along_axis(strength, order, axis=1), axis=1)
        least = [b.least() for b in best]
        # Non-essential: the weakest terms whose bounds together stay below what gets in.
        weak = [0 if x is None else int((u < x).sum()) for x, u in zip(least, upto, strict=True)]
        essential = queries.copy()
        for row, where, n in zip(essential, order, weak, strict=True):
            row[where[:n]] = 0
        # What essential lists add and take away; a vector in none of them gets nothing.
        scores = essential @ vectors.T
        for i, own in enumerate(owns):
            if weak[i] < queries.shape[1]:
                self._probe(scores[i], vectors, queries[i], order[i, : weak[i]], upto[i], least[i], own, best[i])

    def _probe(self, score: np.ndarray, vectors: np.ndarray, query: np.ndarray, weak: np.ndarray, upto: np.ndarray, least: int | None, own: int, best: Best) -> None:
        """Add non-essential terms, the strongest first, to the scores of vectors that can still get in."""
        at = len(weak)
        left = lambda: upto[at - 1] if at else 0
        who = np.arange(len(score)) if least is None else np.flatnonzero(score + left() >= least)
        who = who[self.ids[who] != own]
        score = score[who]
        while at and len(who):
            terms = weak[max(0, at - PROBES) : at]
            score = score + vectors[np.ix_(who, terms)] @ query[terms]
            at = max(0, at - PROBES)
            stay = (score + left() >= least).astype(bool)
            who, score = who[stay], score[stay]
        if score.dtype == object:
            score = np.array([min(max(int(s), _LEAST), _MOST) for s in score], np.int64)
        best.put(score.astype(np.int64), self.ids[who])


def _usable(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): rows that take part."""
    finite = lambda x: x.isNotNull() & F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False))
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of each row of `vectors` that is_query names."""
    spark = vectors.sparkSession
    usable = _usable(vectors, id, vector, scale)
    asked = numbered(_usable(vectors.filter(is_query), id, vector, scale).distinct(), "id")
    size = usable.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    count, width = asked.count(), max(1, size.width or 1)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size.n // TASK_ROWS))
    dealt = checkpointed(usable.repartition(tasks, "id"))
    a_pass, shard_rows = max(1, QUERY_BYTES // (8 * width)), max(1, SHARD_BYTES // (8 * width))
    found = None
    for start in range(0, max(1, count), a_pass):
        some = asked.filter(F.col("n").between(start, start + a_pass - 1)).orderBy("n").collect()
        sent = spark.sparkContext.broadcast(([r.n for r in some], [r.id for r in some], integers(pa.array([r.v for r in some], pa.list_(pa.float64())), width, scale)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            numbers, owns, queries = sent.value
            best = [Best(k) for _ in owns]
            for batch in batches:
                for at in range(0, batch.num_rows, shard_rows):
                    part = batch.slice(at, shard_rows)
                    shard = Shard(part.column(0).to_numpy(), integers(part.column(1), width, scale))
                    for first in range(0, len(owns), TOGETHER):
                        some = slice(first, first + TOGETHER)
                        shard.search(queries[some], owns[some], best[some])
            many = [len(b.id) for b in best]
            columns = [np.repeat(np.array(numbers, np.int64), many), np.repeat(np.array(owns, np.int64), many)]
            columns += [np.concatenate([*(getattr(b, c) for b in best), np.zeros(0, np.int64)]).astype(np.int64) for c in ("id", "score")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n", "query_id", "vec_id", "score"])

        part = dealt.mapInArrow(run, "n bigint, query_id bigint, vec_id bigint, score bigint")
        part = checkpointed(part) if count > a_pass else part
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
