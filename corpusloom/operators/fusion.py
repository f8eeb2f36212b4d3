"""Ranked lists: deduplication by content, reciprocal-rank fusion, candidate pools.

Hits have query_id, variant (order of the query's variants), modality (0 dense, 1 sparse), raw_rank, content_id,
chunk_id and any payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LIST = ("query_id", "variant", "modality")


def weighted_rank(weight: Column, rank: Column, k: int = 60) -> Column:
    return weight / (k + rank)


def fuse(lists: DataFrame, keys: tuple[str, ...] = ("query_id",), item: str = "item_id", k: int = 60) -> DataFrame:
    """Sum of weight / (k + rank) for each item over all lists it stands in. lists: keys, item, rank, weight."""
    return lists.groupBy(*keys, item).agg(F.round(F.sum(weighted_rank(F.col("weight"), F.col("rank"), k)), 12).alias("rrf"))


def first_occurrences(hits: DataFrame, limit: int, keys: tuple[str, ...] = LIST) -> DataFrame:
    """The first hit of each content in a list, ranked anew, up to ``limit``; ``last_raw`` is the raw rank of the last."""
    content = Window.partitionBy(*keys, "content_id").orderBy("raw_rank")
    ranked = Window.partitionBy(*keys).orderBy("raw_rank")
    first = hits.withColumn("nth", F.row_number().over(content)).where("nth = 1").drop("nth")
    return first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)


def contributing(hits: DataFrame, unique: DataFrame, limit: int, keys: tuple[str, ...] = LIST) -> DataFrame:
    """Raw hits up to the one that completed its list; later ones leave no trace."""
    ends = unique.groupBy(*keys).agg(F.max("raw_rank").alias("end"), F.count("*").alias("n"))
    return hits.join(ends, list(keys)).where((F.col("n") < limit) | (F.col("raw_rank") <= F.col("end"))).drop("end", "n")


def representatives(hits: DataFrame, *payload: str) -> DataFrame:
    """For each content of a query: the first hit seen (variants in order, dense before sparse), all its chunk ids."""
    seen = F.struct("variant", "modality", "raw_rank")
    row = F.min_by(F.struct("chunk_id", *payload), seen)
    out = hits.groupBy("query_id", "content_id").agg(row.alias("row"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return out.select("query_id", "content_id", "chunk_ids", *[F.col(f"row.{c}").alias(c) for c in payload])


def local_lists(unique: DataFrame, sparse_weight: float, k: int, rrf_k: int = 60) -> DataFrame:
    """One list a variant from its dense and sparse lists: the k best by fused score, ties by first appearance."""
    weight = F.when(F.col("modality") == 0, 1.0).otherwise(sparse_weight)
    keys = ("query_id", "variant")
    scored = unique.groupBy(*keys, "content_id").agg(F.round(F.sum(weighted_rank(weight, F.col("rank"), rrf_k)), 12).alias("local"), F.min(F.struct("modality", "rank")).alias("seen"))
    order = Window.partitionBy(*keys).orderBy(F.desc("local"), "seen")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def global_scores(local: DataFrame, variants: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Fusion of the variants' lists by their ranks and the variants' weights. variants: query_id, variant, weight."""
    lists = local.join(variants.select("query_id", "variant", "weight"), ["query_id", "variant"])
    return lists.groupBy("query_id", "content_id").agg(F.round(F.sum(weighted_rank(F.col("weight"), F.col("rank"), rrf_k)), 12).alias("rrf"), F.min(F.struct("variant", "rank")).alias("seen"))


def scope_lists(local: DataFrame, variants: DataFrame) -> DataFrame:
    """Lists of scoped variants; of a scope that occurs again only the last list. scope_order is its first place."""
    scoped = variants.where("scope IS NOT NULL").select("query_id", "variant", "scope")
    last = scoped.groupBy("query_id", "scope").agg(F.max("variant").alias("variant"), F.min("variant").alias("scope_order"))
    return local.join(last, ["query_id", "variant"])


def pool(scores: DataFrame, scoped: DataFrame, size: int, reserve: int) -> DataFrame:
    """The ``size`` best contents of a query, then up to ``reserve`` of every scope that aren't among them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "seen")
    main = scores.withColumn("pool_pos", F.row_number().over(order)).where(F.col("pool_pos") <= size).select("query_id", "content_id", "rrf", "pool_pos")
    extra = scoped.where(F.col("rank") <= reserve).join(main.select("query_id", "content_id"), ["query_id", "content_id"], "left_anti")
    extra = extra.groupBy("query_id", "content_id").agg(F.min(F.struct("scope_order", "rank")).alias("at"))
    after = Window.partitionBy("query_id").orderBy("at")
    extra = extra.join(scores.select("query_id", "content_id", "rrf"), ["query_id", "content_id"]).withColumn("pool_pos", F.row_number().over(after) + size)
    return main.unionByName(extra.select(*main.columns))


def matched_scopes(scoped: DataFrame) -> DataFrame:
    return scoped.groupBy("query_id", "content_id").agg(F.array_sort(F.collect_set("scope")).alias("matched_scopes"))


