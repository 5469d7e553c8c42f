"""Exact top-k inner products by an impact-ordered score-at-a-time index.

Components become integers. A block of the table keeps, for each dimension, postings in segments of equal quantised
component. A query takes the block's segments by descending quantised impact, |query component x quantised component|,
and adds each segment's impact to its members' scores. What is left is bounded: by the largest impact that each
dimension still holds, and by the norms for what quantising took away. Only when these bounds prove that few vectors
can be among the best does it stop; those few are scored exactly. Each row goes to one block and each query to every
block: a task builds a block's index once, streams through the queries and passes on its k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
LEVEL = 16
#: A query stops when its possible members are at most this share of a block (or 64), if it can prove it.
SMALL_SHARE = 0.08
CHECKS = (0.35, 0.5, 0.65, 0.8, 1.0)
#: Sums of products below this are exact in floating point.
EXACT = float(1 << 52)
LARGEST = (1 << 63) - 1


def _whole(x: np.ndarray) -> list[int]:
    return [int(v) for v in x.tolist()]


class Index:
    """Posting segments of a block of vectors of whole numbers. Vectors with a very large component are scored one by one, exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, level: int = LEVEL):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order].astype(np.float64)
        self.limit = np.floor(np.sqrt(EXACT / max(1, vectors.shape[1])))
        large = np.abs(vectors).max(axis=1, initial=0) > self.limit
        self.large = [(int(i), _whole(v)) for i, v in zip(ids[large], vectors[large], strict=True)]
        self.ids, self.vectors = ids[~large], vectors[~large]
        coarse = np.rint(self.vectors / level).astype(np.int64)
        self.lost = np.sqrt(((self.vectors - coarse * level) ** 2).sum(axis=1))
        self.members: list[np.ndarray] = []
        dims, values = [], []
        for d in range(coarse.shape[1]):
            at = np.argsort(coarse[:, d], kind="stable").astype(np.int32)
            sorted_values = coarse[at, d]
            start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]][: len(at)])
            for a, b in zip(start, [*start, len(at)][1:], strict=True):
                if sorted_values[a]:  # a segment of impact 0 changes no score
                    self.members.append(at[a:b])
                    dims.append(d)
                    values.append(sorted_values[a] * level)
        self.dims, self.values = np.array(dims, np.int64), np.array(values, np.float64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score) but for the query's own id, by score and then id; scores keep to 64 bits."""
        query = query.astype(np.float64)
        exact = _whole(query)
        found = [(i, sum(map(int.__mul__, exact, v))) for i, v in self.large if i != query_id]
        if np.abs(query).max(initial=0) > self.limit:
            found += [(int(i), sum(map(int.__mul__, exact, _whole(v)))) for i, v in zip(self.ids, self.vectors, strict=True) if i != query_id]
        else:
            found += self._indexed(query_id, query, k)
        bounded = ((i, max(-LARGEST - 1, min(LARGEST, s))) for i, s in found)
        return sorted(bounded, key=lambda x: (-x[1], x[0]))[:k]

    def _indexed(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        n = len(self.ids)
        own = self.ids == query_id
        rest = int(n - own.sum())
        if not rest:
            return []
        k = min(k, rest)
        impacts = query[self.dims] * self.values
        order = np.argsort(-np.abs(impacts), kind="stable")
        sizes = np.abs(impacts)[order]
        scores = np.zeros(n)
        scores[own] = -np.inf
        slack = np.sqrt((query**2).sum()) * self.lost * (1 + 1e-9) + 1e-6
        done = 0
        few = max(64, k, int(SMALL_SHARE * n))
        possible = None
        for share in CHECKS:
            end = int(len(order) * share)
            for s, x in zip(order[done:end].tolist(), impacts[order[done:end]].tolist(), strict=True):
                scores[self.members[s]] += x
            done = end
            # Unseen segments of a dimension add at most its largest unseen impact to any one vector.
            left = np.zeros(len(query))
            np.maximum.at(left, self.dims[order[done:]], sizes[done:])
            bound = slack + left.sum()
            floor = np.partition(scores - bound, n - k)[n - k]
            possible = np.flatnonzero(scores + bound >= floor)
            if len(possible) <= few:
                break
        possible = possible[~own[possible]]
        exact = (self.vectors[possible] @ query).astype(np.int64)
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return [(int(self.ids[possible[i]]), int(exact[i])) for i in best]


def integers(vector: Column) -> Column:
    """floor(256 x) of each component x as a double: whole numbers, still doubles, as those from 2^53 on are whole anyway."""
    top = F.lit(1.7976931348623157e308)

    def one(x: Column) -> Column:
        y = F.least(top, F.greatest(-top, x.cast("double") * 256))
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(vectors: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank (from 1), vec_id, score: each query's k best other rows, ties to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id; shorter
    vectors, also very short next to very long ones, count as filled up with zeros. A query's own row is known by its
    vec_id, so rows that share it are left out. Rows that repeat another's vec_id each take a rank. A query that repeats
    gives the result of one of its rows, the one with the largest vector. Fewer than k other rows give as many results, an
    empty table none. Scores are exact; beyond 64 bits they are the nearest number of 64 bits. Other columns are not read.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), integers(F.col("embedding")).alias("v"), is_query.alias("asks"))
    n_blocks = max(1, -(-rows.count() // block_rows))
    # Dealt by place, not by id: rows that repeat one id spread as well.
    base = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = rows.where("asks").groupBy("vec_id").agg(F.max("v").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, ids, held = None, None, [], []
        for batch in batches:
            found = []
            for block, asks, i, v in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if block != current:
                    current, index, ids, held = block, None, [], []
                if not asks:
                    ids.append(i)
                    held.append(v)
                    continue
                if index is None and ids:
                    width = max(1, *map(len, held))
                    index, held = Index(np.array(ids, np.int64), _matrix(held, width)), []
                if index is not None:
                    width = index.vectors.shape[1]
                    # What a query has beyond the widest vector meets only zeros.
                    found += [(i, j, s) for j, s in index.search(i, _matrix([v[:width]], width)[0], k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    # More tasks than blocks, so that few blocks share one; tasks without a block cost next to nothing.
    dealt = base.unionByName(asked).repartition(4 * n_blocks, "block").sortWithinPartitions("block", "asks")
    near = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
