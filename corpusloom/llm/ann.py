"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component that makes them unit vectors; queries are scaled
to unit length with 0 there. Euclidean distance then orders candidates as the inner product does. A table hashes
with ``M`` functions floor((a . x + b) / W). For a query the chance that a neighbour at the working distance falls into
the same, the next or the previous slot of each function is known; buckets are visited by falling product of
these chances until their sum reaches a level, which is set on a sample (at most ``SAMPLE`` vectors and ``PROBES``
queries of it, all bounded) so that the sample's recall reaches ``AIM``. All vectors are indexed.

Buckets are dealt to shards by table and bucket; shards beyond ``SHARD`` vectors are salted by vector and their
queries go to every part; a shard's queries are split by the same measure, and the vectors go to every part of them. Each
part reranks its candidates exactly, in double precision, and the tables' findings are merged.
Identical vectors are one entry with its smallest ids, as no answer can need more of them. Queries that
found too few, and all where there are at most 2 k distinct vectors, are answered exactly, in blocks of all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, frugal, mix, signed, spread, table

TABLES = 4
SAMPLE, PROBES = 4096, 64
AIM = 0.95
SHARD = 16384


class Hashing:
    def __init__(self, dim: int, functions: int, distance: float, norm: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.m, self.norm, self.distance = functions, norm, distance
        self.width = 1.35 * distance
        self.a = rng.normal(size=(TABLES, functions, dim + 1))
        self.b = rng.uniform(0, self.width, (TABLES, functions))
        self.shifts = np.array(list(product((-1, 0, 1), repeat=functions)), np.int64)
        self.level = 0.3

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])

    def slots(self, points: np.ndarray, k: int) -> np.ndarray:
        return (points @ self.a[k].T + self.b[k]) / self.width

    @staticmethod
    def code(slots: np.ndarray) -> np.ndarray:
        h = np.zeros(slots.shape[:-1], np.uint64)
        for j in range(slots.shape[-1]):
            h = mix(h * np.uint64(31) + slots[..., j].astype(np.int64).astype(np.uint64))
        return signed(h)

    def buckets(self, points: np.ndarray, k: int) -> np.ndarray:
        return self.code(np.floor(self.slots(points, k)))

    def visits(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """Buckets of each query, the likeliest first, up to the level."""
        for at in range(0, len(queries), 64):
            s = self.slots(queries[at : at + 64], k)
            home = np.floor(s)
            f = (s - home) * self.width / self.distance
            w = self.width / self.distance
            edge = np.stack([normal(x) for x in (-f - w, -f, w - f, 2 * w - f)], -1)
            chance = np.diff(edge, axis=-1)
            total = np.ones((len(s), len(self.shifts)))
            for j in range(self.m):
                total *= chance[:, j, :][:, self.shifts[:, j] + 1]
            order = np.argsort(-total, axis=1)
            upto = np.cumsum(np.take_along_axis(total, order, 1), 1)
            for i in range(len(s)):
                n = min(int((upto[i] < self.level).sum()) + 1, order.shape[1])
                yield self.code(home[i] + self.shifts[order[i, :n]])


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (a published rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def fitted(sample: np.ndarray, total: int, norm: float, k: int) -> Hashing:
    """Distance, number of functions and level from a sample of all vectors."""
    n = len(sample)
    asked = sample[:: max(1, n // PROBES)][:PROBES]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked)) * max(1, n // PROBES)] = -np.inf
    near = min(k, n - 1)
    best = np.argsort(-scores, axis=1)[:, :near]
    empty = Hashing(sample.shape[1], 1, 1.0, norm)
    points, queries = empty.points(sample), empty.queries(asked)
    last = np.linalg.norm(points[best[:, -1]] - queries, axis=1)
    functions = int(np.clip(5 + math.floor(math.log(max(total, 1) / 50_000, 8)), 3, 9))
    out = Hashing(sample.shape[1], functions, max(float(np.median(last)), 1e-6), norm)
    for level in np.arange(0.25, 0.96, 0.05):
        out.level = float(level)
        seen = np.zeros((len(asked), n), bool)
        for t in range(TABLES):
            own = out.buckets(points, t)
            for i, some in enumerate(out.visits(queries, t)):
                seen[i] |= np.isin(own, some)
        if np.take_along_axis(seen, best, 1).mean() >= AIM:
            break
    return out


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@frugal
def index_rows(hashing, groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashing.value
        for batch in batches:
            if not len(batch):
                continue
            x = vectors_of(batch.column(2))
            points = h.points(x.astype(np.float64))
            for t in range(TABLES):
                own = h.buckets(points, t)
                cols = [pa.array(t * groups + (own.view(np.uint64) % np.uint64(groups)).astype(np.int64)), pa.array(own), *batch.columns]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "bucket", "rep", "ids", "embedding"])

    return run


@frugal
def query_rows(hashing, groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashing.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                x = vectors_of(some.column(1))
                points = h.queries(x.astype(np.float64))
                row, shard, lists = [], [], []
                for t in range(TABLES):
                    for i, buckets in enumerate(h.visits(points, t)):
                        group = (buckets.view(np.uint64) % np.uint64(groups)).astype(np.int64)
                        for g in np.unique(group).tolist():
                            row.append(i)
                            shard.append(t * groups + g)
                            lists.append(buckets[group == g])
                take = pa.array(row, pa.int64())
                off = pa.array(np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32))
                values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
                cols = [pa.array(shard, pa.int64()), some.column(0).take(take), some.column(1).take(take), pa.ListArray.from_arrays(off, values)]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "query_id", "embedding", "buckets"])

    return run


def rerank(k: int, everything: bool) -> Callable:
    """One part of a shard: the exact best of each query's candidates there."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("rep", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not len(index) or not len(asked):
            return schema.empty_table()
        index, asked = index.combine_chunks(), asked.combine_chunks()
        col = lambda t, name: t.column(name).combine_chunks() if len(t.column(name).chunks) != 1 else t.column(name).chunk(0)
        bucket = np.zeros(len(index), np.int64) if everything else col(index, "bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        x, q = vectors_of(col(index, "embedding"))[order], vectors_of(col(asked, "embedding"))
        rep = col(index, "rep").to_numpy()[order]
        x, q = x.astype(np.float64), q.astype(np.float64)
        who, what, score = [], [], []
        wanted = None if everything else col(asked, "buckets")
        for i, query in enumerate(col(asked, "query_id").to_pylist()):
            if everything:
                at = np.arange(len(x))
            else:
                own = wanted[i].values.to_numpy()
                lo = np.searchsorted(bucket, own, "left")
                at = spread(lo, np.searchsorted(bucket, own, "right") - lo)
            if not len(at):
                continue
            exact = np.einsum("ij,j->i", x[at], q[i])  # a row's sum doesn't hang on its place in the block
            if len(at) > k:
                least = np.partition(exact, len(at) - k)[len(at) - k]
                keep = exact >= least  # ties stay, ids decide
                at, exact = at[keep], exact[keep]
            best = np.lexsort((rep[at], -exact))[:k]
            who += [query] * len(best)
            what.append(at[best])
            score.append(exact[best])
        if not who:
            return schema.empty_table()
        rows = np.concatenate(what)
        return pa.table({"query_id": pa.array(who, pa.int64()), "rep": pa.array(rep[rows]), "ids": col(index, "ids").take(pa.array(order[rows])), "score": pa.array(np.concatenate(score))}, schema=schema)

    return run


RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "query_id long, rep long, ids array<long>, score double"


def nearest(vectors: DataFrame, k: int = 20, query: str = "vec_id % 20 = 0") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all other rows.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id.
    Vectors of different lengths have no inner product: each length is searched by itself. Rows that share an id count once (with
    the smallest vector). Ties go to the smaller id. Other columns aren't read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    clean = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    )
    clean = cut(clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    lengths = [r["d"] for r in clean.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    found = [nearest_of_length(clean.where(F.size("embedding") == d) if len(lengths) > 1 else clean, k, query) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)


def nearest_of_length(clean: DataFrame, k: int, query: str) -> DataFrame:
    spark = clean.sparkSession
    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept = clean.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    reps = cut(kept.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "embedding"), "representatives")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    facts = reps.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    total, rows = facts["n"], clean.count()
    sample = vectors_of(reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()).astype(np.float64)
    asked = clean.where(query).select(F.col("vec_id").alias("query_id"), "embedding")
    groups = max(1, math.ceil(total / SHARD))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    def merged(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "rep").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
        each = one.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k)

    best = None
    if len(sample) > 2 * k:
        hashing = spark.sparkContext.broadcast(fitted(sample, total, facts["norm"] * (1 + 1e-9), k))
        kind = clean.schema["embedding"].dataType.simpleString()
        index = reps.mapInArrow(index_rows(hashing, groups), f"shard long, bucket long, rep long, ids array<long>, embedding {kind}")
        index = cut(index, "index")
        visits = cut(asked.mapInArrow(query_rows(hashing, groups), f"shard long, query_id long, embedding {kind}, buckets array<long>"), "visits")
        parts = index.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("salts"))
        parts = parts.join(visits.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("turns")), "shard")
        salted = index.join(parts, "shard").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts"))).withColumn("turn", numbers(F.col("turns"))).drop("salts", "turns")
        turned = visits.join(parts, "shard").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns"))).withColumn("salt", numbers(F.col("salts"))).drop("salts", "turns")
        found = salted.groupBy("shard", "salt", "turn").cogroup(turned.groupBy("shard", "salt", "turn")).applyInArrow(rerank(k + 1, False), FOUND)
        best = cut(merged(found), "nearest")
        discard(index, visits)
    need = min(k, rows - 1)
    missing = asked if best is None else asked.join(best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= need), "query_id", "left_anti")
    if need > 0 and not missing.isEmpty():
        turns = math.ceil(missing.count() / SHARD)
        blocks = reps.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(groups))).withColumn("turn", numbers(F.lit(turns).cast("long")))
        everywhere = missing.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns))).withColumn("block", numbers(F.lit(groups).cast("long")))
        exact = merged(blocks.groupBy("block", "turn").cogroup(everywhere.groupBy("block", "turn")).applyInArrow(rerank(k + 1, True), FOUND))
        best = exact if best is None else best.join(missing, "query_id", "left_anti").unionByName(exact)
    if best is None:
        return spark.createDataFrame([], RESULT)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_multiprobe_search": op4_multiprobe_search}
