"""Retrieval for whole batches of queries in one plan: variants, two searches, fusion, pool, reranking, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import RetrievalConfig, require
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import bm25, dense, fusion, models, planning, selection
from corpusloom.sources.scratch import cut


def baseline(queries: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], dim: int, k: int = 10) -> DataFrame:
    """Trim, embed, check, search. queries: query_id, query; vectors: vec_id, embedding."""
    require(k > 0, "k must be positive")
    asked = queries.withColumn("query", T.strip(F.col("query"))).where("query <> ''")
    return dense.search(vectors, asked.select("query_id", V.checked(embed(F.col("query")), dim).alias("embedding")), k)


def hybrid(plans: DataFrame, chunks: DataFrame, index: bm25.Bm25Index | None, embed: Callable[[Column], Column] | None, k: int = 10, config: RetrievalConfig = RetrievalConfig(),
           rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, position, chunk_id, content_id, relevance, rrf, article_id, text, matched_scopes, chunk_ids.

    plans: as planning.build gives them. chunks: doc_id (long), chunk_id, article_id, text, and embedding where dense
    search is used. One job for all queries and variants; texts are joined after the pools are made."""
    require(k > 0, "k must be positive")
    require(index is not None or embed is not None, "there is nothing to search")
    variants = planning.variants(plans).withColumn("variant_id", F.xxhash64("query_id", "variant"))
    keys = variants.select("variant_id", "query_id", "variant")
    lists = []
    if embed is not None:
        asked = variants.select(F.col("variant_id").alias("query_id"), embed(F.col("text")).alias("embedding"))
        found = dense.search(chunks.select(F.col("doc_id").alias("vec_id"), "embedding"), asked, config.raw_k)
        lists.append(found.select(F.col("query_id").alias("variant_id"), F.col("vec_id").alias("doc_id"), F.col("rank").alias("raw_rank"), F.lit(0).alias("modality")))
    if index is not None:
        asked = variants.select(F.col("variant_id").alias("query_id"), T.sparse_query(F.col("text"), F.col("lexical_terms")).alias("text"))
        found = bm25.search(index, asked, config.raw_k)
        lists.append(found.select(F.col("query_id").alias("variant_id"), "doc_id", F.col("rank").alias("raw_rank"), F.lit(1).alias("modality")))
    hits = cut(lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1]), "hits")  # at most raw_k rows a list
    found = chunks.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")  # only what was found is identified
    identity = found.select("doc_id", "chunk_id", "article_id", T.content_id(F.col("article_id"), F.col("text"), strict=False).alias("content_id"))
    hits = cut(hits.join(identity, "doc_id").join(keys, "variant_id"), "identified")

    unique = fusion.first_occurrences(hits, config.per_query_top_k)
    used = fusion.contributing(hits, unique, config.per_query_top_k)
    local = fusion.local_lists(unique, config.sparse_weight, config.per_query_top_k, config.rrf_k)
    scores = fusion.global_scores(local, variants, config.rrf_k)
    scoped = fusion.scope_lists(local, variants)
    pool = fusion.pool(scores, scoped, config.candidate_pool_size, config.scope_candidates_per_branch)
    candidates = pool.join(fusion.representatives(used, "doc_id", "article_id"), ["query_id", "content_id"]).join(fusion.matched_scopes(scoped), ["query_id", "content_id"], "left")
    candidates = candidates.withColumn("matched_scopes", F.coalesce("matched_scopes", T.empty_strings())).join(chunks.select("doc_id", "text", *(["article_title"] if "article_title" in chunks.columns else [])), "doc_id")
    order = F.array_sort(F.collect_set(F.struct("scope_order", "scope")))
    required = scoped.groupBy("query_id").agg(F.transform(order, lambda x: x["scope"]).alias("scopes"))
    scope_map = F.map_from_entries(F.array_distinct(F.transform(F.filter("semantic_queries", lambda v: v["scope"].isNotNull()), lambda v: F.struct(v["scope"].alias("k"), v["text"].alias("v")))))
    facts = plans.select("query_id", "query_type", "intent", "query", scope_map.alias("scope_queries"))
    candidates = candidates.join(facts, "query_id").join(required, "query_id", "left")
    scored = None
    if rerank is not None:
        title = F.col("article_title") if "article_title" in chunks.columns else F.lit("")
        q, d = models.rerank_pair(F.col("query"), F.col("intent"), F.col("scope_queries"), title, F.col("matched_scopes"), F.col("text"))
        scored = candidates.select("query_id", "content_id", rerank(q, d).alias("score"))
    ranked = selection.rerank_or_pass(candidates, scored)
    ambiguous = F.col("query_type") == "ambiguous"
    plain = selection.capped(ranked.where(~ambiguous), k, config.max_chunks_per_article)
    with_scopes = ranked.where(ambiguous).withColumn("required_scopes", F.coalesce("scopes", T.empty_strings()))
    margin = config.scope_relevance_margin if rerank is not None else None
    chosen = selection.select_scoped(with_scopes, k, config.ambiguous_max_chunks_per_article, True, margin).select("query_id", "content_id", "position")
    out = plain.select("query_id", "content_id", "position").unionByName(chosen).join(ranked, ["query_id", "content_id"])
    return out.select("query_id", "position", F.element_at("chunk_ids", 1).alias("chunk_id"), "content_id", "relevance", "rrf", "article_id", "text", "matched_scopes", "chunk_ids")
