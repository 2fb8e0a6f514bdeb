"""Approximate nearest neighbours by cosine: a hash-prefix forest over shards of the vectors.

A tree gives every vector a long hash string, one bit a random hyperplane,
and keeps the strings as a sorted array, so the vectors that share any prefix
with a query are one slice of it.  A search descends in every tree to its
longest matching prefix and then ascends in all trees together, one bit at a
time: each step adds the vectors whose match is just that long, scores them
with the exact measure, and stops as soon as a vector as near as the worst of
the answer so far would have been met already, but for a chance of ``MISS``.
A bit agrees for two vectors of angle ``t`` with probability ``1 - t / pi``,
so this chance is known without any fit to the data; nothing is sampled, every
row is indexed, and the rule is the same for any number of rows.

Spark deals the rows into shards of a bounded number of numbers.  The queries
go to all shards in blocks of a bounded size (each block is broadcast, its
size is fixed by ``BLOCK_NUMBERS``); a task keeps the best ``k`` of each query
over its shards, and one aggregation merges what the tasks found.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component takes no part, neither do rows without an id.  Vectors are
compared with those of the same length only.  An id names a row: the rows with
the query's id are no candidates, an id is listed once with its best score, and
of several query rows with one id the smallest vector (array order) asks.
Equal scores stand in the order of ids.  An empty table gives no rows, a query
without candidates none either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Answers a query.
K = 5
#: Trees of the forest, and bits of a hash string.
TREES, BITS = 64, 32
#: The chance to miss a neighbour as near as the worst one found.
MISS = 0.05
#: Numbers (vector components) of a shard and of a block of queries.
SHARD_NUMBERS = 1 << 20
BLOCK_NUMBERS = 1 << 22
#: Queries whose slices are looked up at once.
_ASKED = 1024
#: More than two ways to add up a product can differ by.
_ROUNDING = 1e-9
_SEED = 20_011


def hyperplanes(tree: int, dim: int) -> np.ndarray:
    """(dim, BITS): the same in every task."""
    return np.random.default_rng((_SEED, dim, tree)).standard_normal((dim, BITS))


def hash_strings(unit: np.ndarray, tree: int) -> np.ndarray:
    """One string a row: bit i, from the front, is the side of hyperplane i."""
    side = unit @ hyperplanes(tree, unit.shape[1]) >= 0
    return np.packbits(side, axis=1).view(">u4").ravel().astype(np.uint32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows over a power of two each, which changes no cosine and keeps squares in range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Best:
    """The best k (score, id) of every query so far, ids once each."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def least(self, q: int, score: np.ndarray, ids: np.ndarray) -> float:
        """What a score must reach to be among the best of these and those so far."""
        if len(score) <= 4 * self.k:
            return -np.inf
        own = np.partition(score, -self.k)[-self.k]
        if np.unique(ids[score >= own]).size < self.k:  # an id over and over
            own = -np.inf
        return max(own, self.score[q, -1])

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((ids, -score))
        score, ids = score[order], ids[order]
        first = np.sort(np.unique(ids[np.isfinite(score)], return_index=True)[1])[:self.k]
        self.score[q, :], self.id[q, :] = -np.inf, np.iinfo(np.int64).max
        self.score[q, :len(first)], self.id[q, :len(first)] = score[first], ids[first]


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best,
                 rows: np.ndarray, trees: int = TREES, miss: float = MISS) -> int:
    """Search a forest over ``vectors`` for ``queries`` (rows ``rows`` of ``best``); how many scores it took."""
    unit = scaled(vectors)
    norm = np.sqrt((unit * unit).sum(axis=1))
    q_unit = scaled(queries)
    q_norm = np.sqrt((q_unit * q_unit).sum(axis=1))
    order, strings, q_strings = [], [], []
    for tree in range(trees):
        own = hash_strings(unit, tree)
        by = np.argsort(own, kind="stable")
        order.append(by)
        strings.append(own[by])
        q_strings.append(hash_strings(q_unit, tree))
    return sum(_ascend(ids, unit, norm, query_ids[i:i + _ASKED], q_unit[i:i + _ASKED], q_norm[i:i + _ASKED], order, strings,
                       [s[i:i + _ASKED] for s in q_strings], best, rows[i:i + _ASKED], miss)
               for i in range(0, len(queries), _ASKED))


def _ascend(ids: np.ndarray, unit: np.ndarray, norm: np.ndarray, query_ids: np.ndarray, q_unit: np.ndarray, q_norm: np.ndarray,
            order: list[np.ndarray], strings: list[np.ndarray], q_strings: list[np.ndarray], best: Best, rows: np.ndarray,
            miss: float) -> int:
    """The synchronous ascent of some queries; how many scores it took."""
    trees = len(order)
    # slices[tree, bits, query]: where the strings that share so many bits with the query's begin and end
    low = np.empty((trees, BITS + 1, len(query_ids)), np.int64)
    high = np.empty_like(low)
    for bits in range(BITS + 1):
        rest = np.uint32((1 << (BITS - bits)) - 1)
        for tree in range(trees):
            low[tree, bits] = np.searchsorted(strings[tree], q_strings[tree] & ~rest, "left")
            high[tree, bits] = np.searchsorted(strings[tree], q_strings[tree] | rest, "right")
    taken, seen, here = 0, np.empty(len(ids), bool), np.empty(len(ids), bool)
    for q in range(len(query_ids)):
        seen[:] = ids == query_ids[q]
        for bits in range(BITS, -1, -1):
            a, b = low[:, bits, q], high[:, bits, q]
            below = (low[:, bits + 1, q], high[:, bits + 1, q]) if bits < BITS else (a, a)
            new = [order[t][lo:hi] for t in np.flatnonzero((a < below[0]) | (b > below[1]))
                   for lo, hi in ((a[t], below[0][t]), (below[1][t], b[t])) if lo < hi]
            if new:
                here[:] = False
                here[np.concatenate(new)] = True
                at = np.flatnonzero(here & ~seen)
                seen |= here
                taken += len(at)
                near = unit[at] @ q_unit[q] / (norm[at] * q_norm[q]) if len(at) else norm[:0]
                if len(at):  # the product above may round equal rows apart, what can be an answer is scored row by row
                    at = at[near >= best.least(rows[q], near, ids[at]) - _ROUNDING]
                    best.add(rows[q], (unit[at] * q_unit[q]).sum(axis=1) / (norm[at] * q_norm[q]), ids[at])
            worst = best.score[rows[q], -1]
            if bits and worst > -np.inf:
                agree = 1 - np.arccos(min(1.0, worst)) / np.pi
                if (1 - agree ** bits) ** trees <= miss:
                    break
    return taken


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id LONG, vector ARRAY<DOUBLE>): the rows that take part."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("vector"))
    return (rows.where("vec_id is not null and size(vector) > 0")
            .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
            .where(F.exists("vector", lambda x: x != 0)))


def _by_length(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (ids, matrix)."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    ends = ends - ends[0]
    ids, size = ids.to_numpy(), np.diff(ends)
    out = {}
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        out[int(dim)] = ids[rows], flat[ends[rows][:, None] + np.arange(dim)].astype(np.float64)
    return out


def _search(spark, rows: DataFrame, block: pa.Table, k: int, trees: int, miss: float) -> DataFrame:
    """(query_id, vec_id, score): the best k of every query of a block in every task's rows."""
    sent = spark.sparkContext.broadcast({d: (i, m) for d, (i, m) in _by_length(
        block.column("vec_id").combine_chunks(), block.column("vector").combine_chunks()).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, at = sent.value, {}
        n = 0
        for dim, (ids, _) in blocks.items():
            at[dim] = np.arange(n, n + len(ids))
            n += len(ids)
        best, held, numbers = Best(n, k), [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            for dim, (ids, matrix) in _by_length(table.column(0).combine_chunks(), table.column(1).combine_chunks()).items():
                if dim in blocks:
                    search_shard(ids, matrix, *blocks[dim], best, at[dim], trees, miss)

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                held.append(part)
                numbers += len(part.column(1).flatten())
                if numbers >= SHARD_NUMBERS:
                    flush()
                    held, numbers = [], 0
        if held:
            flush()
        query = np.concatenate([ids for ids, _ in blocks.values()]).repeat(k)
        found = np.isfinite(best.score.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(query[found]), pa.array(best.id.ravel()[found]), pa.array(best.score.ravel()[found])],
                                         names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = TREES, miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row that meets ``is_query``.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    n, numbers = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    widest = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    blocks = max(1, -(-asked.count() * widest // BLOCK_NUMBERS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    if blocks > 1:
        asked = written(asked, "queries")
    dealt = rows.repartition(max(1, -(-numbers // SHARD_NUMBERS)))
    if blocks > 1:
        dealt = written(dealt, "vectors")
    found = []
    for b in range(blocks):
        block = asked.where(F.col("block") == b).select("vec_id", "vector").toArrow()
        if block.num_rows:
            part = _search(spark, dealt, block, k, trees, miss)
            found.append(written(part, "neighbours") if blocks > 1 else part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    merged = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
