"""Choosing results: order by relevance, caps an article, scopes that must be present, score floors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def by_relevance(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("relevance"), F.desc("rrf"), "pool_pos")


def rerank_or_pass(candidates: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """relevance: the reranker's score where there is one, the fused score else. scores: query_id, content_id, score."""
    if scores is None:
        return candidates.withColumn("relevance", F.col("rrf"))
    joined = candidates.join(scores.select("query_id", "content_id", F.col("score").alias("rerank")), ["query_id", "content_id"], "left")
    return joined.withColumn("relevance", F.coalesce("rerank", "rrf")).drop("rerank")


def within_margin(score: Column, margin: float, *keys: str) -> Column:
    return score >= F.max(score).over(Window.partitionBy(*keys)) - margin


def filter_min_score(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("score").isNotNull() & (F.col("score") >= least))


def filter_score_margin(df: DataFrame, margin: float, key: str = "query_id") -> DataFrame:
    return df.withColumn("near", within_margin(F.col("score"), margin, key)).where("near").drop("near")


def restrict_scopes(df: DataFrame, scopes: Column) -> DataFrame:
    return df.where(F.arrays_overlap("matched_scopes", scopes))


def capped(candidates: DataFrame, k: int, per_article: int) -> DataFrame:
    """The k best of a query with at most ``per_article`` of an article (a blank article has no cap): windows only."""
    blank = F.coalesce(F.col("article_id"), F.lit("")) == ""
    nth = F.row_number().over(by_relevance("query_id", "article_id"))
    kept = candidates.withColumn("nth", nth).where(blank | (F.col("nth") <= per_article)).drop("nth")
    return kept.withColumn("position", F.row_number().over(by_relevance("query_id"))).where(F.col("position") <= k)


def choose(rows: pd.DataFrame, k: int, per_article: int, restrict: bool, margin: float | None) -> pd.DataFrame:
    """One query: a winner for every required scope, sorted, then the others in order above the floor, under the cap."""
    rows = rows.sort_values(["relevance", "rrf", "pool_pos"], ascending=[False, False, True], kind="stable").reset_index(drop=True)
    required = list(rows["required_scopes"].iloc[0]) if len(rows) and rows["required_scopes"].iloc[0] is not None else []
    scopes = [set(x) if x is not None else set() for x in rows["matched_scopes"]]
    article = [a or "" for a in rows["article_id"]]
    open_rows = [i for i in range(len(rows)) if not (restrict and required) or scopes[i] & set(required)]
    used: dict[str, int] = {}
    taken: list[int] = []

    def fits(i: int) -> bool:
        return i not in taken and (not article[i] or used.get(article[i], 0) < per_article)

    def take(i: int) -> None:
        taken.append(i)
        used[article[i]] = used.get(article[i], 0) + 1

    for scope in required:
        winner = next((i for i in open_rows if scope in scopes[i] and fits(i)), None)
        if winner is not None:
            take(winner)
    taken.sort()
    floor = min(rows["relevance"][i] for i in taken) - margin if taken and margin is not None else None
    for i in open_rows:
        if fits(i) and (floor is None or rows["relevance"][i] >= floor):
            take(i)
    out = rows.iloc[taken[:k]].copy()
    out["position"] = range(1, len(out) + 1)
    return out


def select_scoped(candidates: DataFrame, k: int, per_article: int, restrict: bool = True, margin: float | None = None) -> DataFrame:
    """The sequential choice, a query at a time (a candidate pool is at most a hundred rows).

    candidates: query_id, content_id, article_id, relevance, rrf, pool_pos, matched_scopes, required_scopes (in order)."""
    cols = candidates.select("query_id", "content_id", "article_id", "relevance", "rrf", "pool_pos", "matched_scopes", "required_scopes")
    schema = cols.schema.simpleString()[7:-1] + ",position:int"
    return cols.groupBy("query_id").applyInPandas(lambda rows: choose(rows, k, per_article, restrict, margin), ", ".join(x.replace(":", " ", 1) for x in split_fields(schema)))


def split_fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]
