"""Approximate nearest neighbours by collision counting.

Every hash function is one random projection, kept as a sorted array. For a
query, a window centred at the query's own projection opens on each array; a
vector inside collides. Virtual rehashing widens all windows round by round, and
each round reads only what the windows gained. A vector whose collisions reach
the threshold is verified by its exact cosine. A query ends when its k-th best
verified vector is as near as the round's radius, or enough have been verified.

Vectors are indexed as unit vectors, where a smaller distance is a larger
cosine; cosines are computed in double precision from the original vectors. All
rows are indexed; nothing is fitted. Results: rows whose vec_id is null or whose
vector is null, empty, zero or not finite take no part; rows with a query's own
vec_id are not its candidates, and of several rows with one queried vec_id the
smallest vector asks. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm.vector_grid import GridConfig, finite_vectors, gathered, grid_search, top


@dataclass(frozen=True)
class AnnConfig:
    k: int = 5
    projections: int = 80
    radii: tuple[float, ...] = (0.4, 0.8, 1.12, 1.3, 1.42, 2.0)  # of unit vectors, up to their largest distance
    half_width: float = 1.0  # of the windows, in radii
    slack: float = 1.8  # standard deviations below the expected collisions at the radius
    enough: float = 0.15  # share of a block that is verified at most before a query ends
    seed: int = 5
    grid: GridConfig = field(default_factory=GridConfig)


def _collision_share(half_width: float) -> float:
    """How often a vector at the radius collides: a standard normal value within the half width."""
    from math import erf, sqrt

    return erf(half_width / sqrt(2))


class CollisionIndex:
    """The index of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cfg: AnnConfig):
        self.ids, self.vectors, self.cfg = ids, vectors, cfg
        self.norms = np.sqrt(np.square(vectors).sum(axis=1))
        self.hashes = np.random.default_rng(cfg.seed).standard_normal((vectors.shape[1], cfg.projections))
        at = (vectors / self.norms[:, None]) @ self.hashes
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(at.T, self.order, axis=1)
        p, m = _collision_share(cfg.half_width), cfg.projections
        self.threshold = int(np.floor(m * p - cfg.slack * np.sqrt(m * p * (1 - p))))

    def search(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best verified vectors."""
        cfg, n = self.cfg, len(self.ids)
        norm = np.sqrt(np.square(query).sum())
        center = (query / norm) @ self.hashes
        counts = np.zeros(n, dtype=np.int64)
        checked = self.ids == query_id
        found_at, found = np.empty(0, dtype=np.int64), np.empty(0)
        low = high = None
        for radius in cfg.radii:
            w = cfg.half_width * radius
            new_low = [int(s.searchsorted(c - w)) for s, c in zip(self.sorted, center, strict=True)]
            new_high = [int(s.searchsorted(c + w, side="right")) for s, c in zip(self.sorted, center, strict=True)]
            if low is None:
                gained = [o[x:y] for o, x, y in zip(self.order, new_low, new_high, strict=True)]
            else:
                gained = [o[x:y] for o, x, y in zip(self.order, new_low, low, strict=True)]
                gained += [o[x:y] for o, x, y in zip(self.order, high, new_high, strict=True)]
            counts += np.bincount(np.concatenate(gained), minlength=n)
            low, high = new_low, new_high
            fresh = np.flatnonzero((counts >= self.threshold) & ~checked)
            checked[fresh] = True
            cosines = (self.vectors[fresh] * query).sum(axis=1) / (self.norms[fresh] * norm)
            found_at, found = np.concatenate([found_at, fresh]), np.concatenate([found, cosines])
            keep = top(self.ids[found_at], found, cfg.k)
            if len(keep) == cfg.k and (2 - 2 * found[keep[-1]] <= radius * radius or len(found_at) >= cfg.enough * n + cfg.k):
                break
        else:  # the widest windows may still miss: few vectors, or opposite ones
            if len(keep) < cfg.k:
                found_at = np.flatnonzero(self.ids != query_id)
                found = (self.vectors[found_at] * query).sum(axis=1) / (self.norms[found_at] * norm)
                keep = top(self.ids[found_at], found, cfg.k)
        return self.ids[found_at[keep]], found[keep]


def nearest(table: DataFrame, query_rule: str, cfg: AnnConfig | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``table`` (vec_id, embedding) that ``query_rule`` picks as queries."""
    cfg = cfg or AnnConfig()
    vectors = finite_vectors(table, nonzero=True)
    queries = vectors.filter(query_rule).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))

    def index(ids: np.ndarray, block: np.ndarray):
        made = CollisionIndex(ids, block, cfg)
        return lambda query_ids, chunk: gathered(query_ids, [made.search(q, x) for q, x in zip(query_ids.tolist(), chunk, strict=True)])

    return grid_search(vectors, queries, index, "double", cfg.k, cfg.grid)
