"""Blocks of vectors and the queries that walk through them, for searches of a stated query set.

Rows are dealt by hash into blocks of bounded size, so equal vectors and repeated
ids spread. A task gets each of its blocks once, builds the block's index, and
then reads the queries batch by batch, so it holds one block and one batch of
queries, whatever the table's size. Vectors are shuffled once; queries, the small
side, go to every block, as any of them may hold a query's best rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From the ids and vectors of queries to three arrays: query ids, ids and scores of at least the k best of a block.
Search = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class GridConfig:
    block_rows: int = 16384


def finite_vectors(table: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, vector (doubles), dim of the rows that take part: an id, and a vector of finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0").filter(sound)
    if nonzero:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    return rows.withColumn("dim", F.size("vector"))


def grid_search(vectors: DataFrame, queries: DataFrame, index: Callable[[np.ndarray, np.ndarray], Search], score_type: str, k: int, cfg: GridConfig, order: Callable[[str], Column] = F.desc) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query.

    ``vectors`` and ``queries`` have vec_id, dim and vector (an array of one
    numeric type); vectors of other lengths than a query's are no candidates.
    ``index(ids, block)`` gives the search of one block.
    """
    blocks = max(1, -(-vectors.count() // cfg.block_rows))
    dealt = F.pmod(F.xxhash64(F.lit("block"), "vec_id", "vector", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    v = vectors.select("dim", dealt.alias("block"), F.lit(0).alias("asks"), "vec_id", "vector")
    q = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "vector")
    tasks = max(blocks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = v.unionByName(q).repartition(tasks, "dim", "block").sortWithinPartitions("dim", "block", "asks", "vec_id", "vector")
    score = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, search = None, [], None
        for batch in batches:
            for part, key in _runs(batch):
                ids, flat = part.column("vec_id").to_numpy(), part.column("vector").flatten().to_numpy(zero_copy_only=False)
                found = ids, np.ascontiguousarray(flat.reshape(len(ids), -1))
                if key[:2] != at:
                    at, block, search = key[:2], [], None
                if not key[2]:
                    block.append(found)
                elif block or search:
                    if search is None:
                        search, block = index(*(np.concatenate(x) for x in zip(*block, strict=True))), []
                    columns = zip(search(*found), (pa.int64(), pa.int64(), score), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in columns], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    place = Window.partitionBy("query_id").orderBy(order("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[int, int, int]]]:
    """Slices of equal dim, block and asks."""
    keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "block", "asks")], axis=1)
    if len(keys):
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            yield batch.slice(i, j - i), tuple(keys[i].tolist())


def gathered(query_ids: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (ids, scores) of each query as three arrays."""
    return np.repeat(query_ids, [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    order = np.argsort(ids[at], kind="stable")
    at = at[order]
    return at[np.argsort(-scores[at], kind="stable")][:k]
