"""Exact top-k search by no-random-access aggregation.

Each dimension is a list of (vector, component), sorted once a block; for a
query, it is read from the end where the contribution (component times the
query's) is largest. All lists are read in step. A vector's score is at least
what has been read of it plus the smallest contribution of each list not yet
read for it, at most that plus the last contribution read there. Reading stops
when the vectors whose upper bound reaches the k-th largest lower bound are few;
these alone can qualify, and their final scores are then resolved.

Components are floor(1024 * x) of the double x, of any size; scores are exact integer inner
products. Where sums pass 2**53, reading goes on with scaled doubles, whose bounds are widened
by what rounding may cost, and final scores are resolved in whole numbers. A best score that
no 64-bit number is (or that is the least of them) is an error.

Results: rows whose vec_id is null or whose vector is null, empty or holds null or non-finite
components take no part (zero vectors do); rows with a query's own vec_id are not its
candidates, and of several rows with one queried vec_id the smallest vector asks. Ties go to
the smaller vec_id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm.vector_grid import GridConfig, finite_vectors, gathered, grid_search, top


@dataclass(frozen=True)
class TopKConfig:
    k: int = 10
    scale: int = 1024
    depths: tuple[float, ...] = (0.05, 0.35, 0.6, 0.75, 0.9, 1.0)  # shares of the lists after which bounds are compared
    resolved: int = 2048  # reading stops when at most so many vectors can qualify
    grid: GridConfig = field(default_factory=GridConfig)


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit numbers where doubles hold them all exactly, else as Python's."""
    if np.abs(vectors).max(initial=0) * scale < 1 << 53:
        return np.floor(vectors * scale).astype(np.int64)
    one = lambda x: int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)
    return np.array([[one(x) for x in row] for row in vectors.tolist()], dtype=object).reshape(vectors.shape)


def readable(whole: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``whole`` as doubles: the same numbers, or, of large ones, the vectors scaled to at most 1."""
    if whole.dtype != object:
        return whole.astype(np.float64)
    return np.ldexp(vectors, -int(np.frexp(np.abs(vectors).max())[1]))


class SortedLists:
    """The lists of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cfg: TopKConfig):
        self.ids, self.cfg, self.whole = ids, cfg, whole_numbers(vectors, cfg.scale)
        reading = readable(self.whole, vectors)
        self.largest = np.abs(reading).max(initial=0)
        self.order = np.argsort(reading, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(reading.T, self.order, axis=1)

    def _unread(self, whose: list[np.ndarray], each: np.ndarray) -> np.ndarray:
        """For every vector, the sum of ``each`` over the lists in which it has not been met."""
        out = np.full(len(self.ids), each.sum())
        for at in whose:
            out -= np.bincount(at.ravel(), weights=np.repeat(each, at.shape[1]), minlength=len(self.ids))
        return out

    def search(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for a query of doubles."""
        cfg, n, d = self.cfg, len(self.ids), len(query)
        whole = whole_numbers(query[None, :], cfg.scale)
        reads = readable(whole, query[None, :])[0]
        most = d * self.largest * np.abs(reads).max(initial=0)
        exact = whole.dtype != object and self.whole.dtype != object and most < 1 << 53
        slack = 0.0 if exact else most * (8 * d + 64) * 2.0**-53  # a few roundings a list, of sums up to ``most``
        own = self.ids == query_id
        lists = []  # the largest contributions first
        for i, w in enumerate(reads.tolist()):
            step = -1 if w > 0 else 1
            lists.append((self.order[i][::step], self.values[i][::step] * w))
        least = np.array([c[-1] for _, c in lists])
        read = np.zeros(n)
        begin, whose = 0, []
        for share in cfg.depths:
            end = min(n, int(np.ceil(share * n)))
            if end <= begin:
                continue
            at = np.concatenate([order[begin:end] for order, _ in lists])
            read += np.bincount(at, weights=np.concatenate([gain[begin:end] for _, gain in lists]), minlength=n)
            whose.append(at.reshape(d, -1))
            begin = end
            last = np.array([c[end - 1] for _, c in lists])
            lower, upper = read + self._unread(whose, least) - slack, read + self._unread(whose, last) + slack
            lower[own] = upper[own] = -np.inf
            bar = np.partition(lower, n - cfg.k)[n - cfg.k] if n > cfg.k else -np.inf
            can = np.flatnonzero((upper >= bar) & ~own)
            if len(can) <= cfg.resolved or end == n:
                break
        if exact:
            scores = self.whole[can] @ whole[0]
            keep = top(self.ids[can], scores, cfg.k)
            return self.ids[can[keep]], scores[keep]
        scores = (self.whole[can].astype(object) @ whole[0].astype(object)).tolist()
        best = sorted(zip((-s for s in scores), self.ids[can].tolist(), strict=True))[: cfg.k]
        if best and -best[0][0] >= 1 << 63:  # among the best of all too, or below others like it
            raise OverflowError(f"query {query_id}: a score of {-best[0][0]} is no 64-bit number")
        return np.array([i for _, i in best], np.int64), np.array([max(-s, LEAST) for s, _ in best], np.int64)


#: Stands for scores that are smaller; refused where it is among a query's best.
LEAST = -(1 << 63)


def best_products(table: DataFrame, query_rule: str, cfg: TopKConfig | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``table`` (vec_id, embedding) that ``query_rule`` picks as queries."""
    cfg = cfg or TopKConfig()
    vectors = finite_vectors(table, nonzero=False)
    queries = vectors.filter(query_rule).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))

    def index(ids: np.ndarray, block: np.ndarray):
        lists = SortedLists(ids, block, cfg)
        return lambda query_ids, chunk: gathered(query_ids, [lists.search(q, x) for q, x in zip(query_ids.tolist(), chunk, strict=True)])

    found = grid_search(vectors, queries, index, "long", cfg.k, cfg.grid)
    small = F.raise_error(F.format_string("query %d: a best score is too small for a 64-bit number", "query_id")).cast("long")
    return found.withColumn("score", F.when(F.col("score") == LEAST, small).otherwise(F.col("score")))
