"""Exact vector search for batches of queries.

Queries go to the vectors in blocks of at most ``BLOCK_FLOATS`` numbers (a fixed bound, whatever their number): each
block is broadcast, a task goes over its vectors in tiles of at most ``TILE_FLOATS`` products and keeps k rows a query, and
a window merges the tasks' findings. A block costs one scan of the vectors; no row pair is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import cut, spread_out

from .bm25 import PLACES
from .ranking import keep_best

BLOCK_FLOATS = 8_000_000
#: Products that a task holds at a time, and vectors on one side of them.
TILE_FLOATS, TILE_VECTORS = 2_000_000, 2_000
#: Rows of a batch that a task gives out.
OUT_ROWS = 50_000


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _merge(best: tuple[np.ndarray, np.ndarray], near: np.ndarray, own: np.ndarray, asked: np.ndarray | None) -> None:
    """Take a tile's products (a row a query) into the k best of its queries: ids and scores, no score being -inf. asked: the
    queries' ids where a vector of the same id doesn't count."""
    ids, scores = best
    k, least = ids.shape[1], scores[:, -1].copy()
    wanted = k + (asked is not None)
    new = np.flatnonzero(least == -np.inf)
    if len(new) and near.shape[1] > wanted:
        some = np.where(np.isnan(near[new]), -np.inf, near[new])
        least[new] = np.partition(some, -wanted, axis=1)[:, -wanted]
    row, col = np.nonzero(near >= (least - 10.0**-PLACES)[:, None])  # rounding moves a score by less
    score, what = np.round(near[row, col], PLACES), own[col]
    ok = score > -np.inf if asked is None else (score > -np.inf) & (asked[row] != what)
    keep_best(scores, [ids], row[ok], score[ok], [what[ok]])


def _scan(block, k: int, unit: bool, other_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        if k < 1:
            return
        found, scores = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
        high = max(1, TILE_FLOATS // TILE_VECTORS)
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            x = _unit(x) if unit else x
            for at in range(0, len(own), TILE_VECTORS):
                for a in range(0, len(ids), high):
                    part = slice(a, a + high)
                    _merge((found[part], scores[part]), q[part] @ x[at : at + TILE_VECTORS].T, own[at : at + TILE_VECTORS], ids[part] if other_only else None)
        for a in range(0, len(ids), max(1, OUT_ROWS // max(1, k))):
            part = slice(a, a + max(1, OUT_ROWS // max(1, k)))
            keep = scores[part] > -np.inf
            who = np.broadcast_to(ids[part, None], keep.shape)
            yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(found[part][keep]), pa.array(scores[part][keep])], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, cosine: bool = True, other_only: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: vectors (vec_id, embedding), queries (query_id, embedding), all of one dimension.

    Rows with null vectors take no part; ties go to the smaller id."""
    spark = vectors.sparkSession
    x = spread_out(vectors.where("embedding IS NOT NULL").select("vec_id", "embedding"), "vec_id")
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    first = asked.select(F.size("embedding").alias("d"), F.lit(0)).first()
    size = max(1, BLOCK_FLOATS // max(1, first["d"], 2 * k)) if first else 1
    parts = max(1, -(-asked.count() // size))
    if parts > 1:  # what queries are made from is read once
        asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts))), "queries")
    found = None
    for p in range(parts):
        some = asked if parts == 1 else asked.where(F.col("block") == p).drop("block")
        t = some.toArrow().combine_chunks()  # at most about BLOCK_FLOATS numbers
        ids = t.column(0).to_numpy().astype(np.int64) if len(t) else np.zeros(0, np.int64)
        q = _matrix(t.column(1).combine_chunks()) if len(t) else np.zeros((0, 1))
        block = spark.sparkContext.broadcast((ids, _unit(q) if cosine else q))
        part = x.mapInArrow(_scan(block, k, cosine, other_only), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
