"""From questions to answer records in one job a slice: retrieval, citations, contexts, answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import CitationConfig, ContextConfig, RetrievalConfig
from corpusloom.operators import bm25, citations, models, planning, submission
from corpusloom.plans import planner, retrieval


@dataclass(frozen=True)
class Engine:
    """What retrieval needs; ``plans`` makes query plans (none: the query alone)."""

    chunks: DataFrame  # doc_id, chunk_id, article_id, text, article_title, and embedding where there is an embedder
    index: bm25.Bm25Index | None
    embed: Callable[[Column], Column] | None
    rerank: Callable[[Column, Column], Column] | None = None
    make_planner: Callable[[], models.Generator] | None = None
    config: RetrievalConfig = RetrievalConfig()

    def plans(self, queries: DataFrame) -> DataFrame:
        return planning.original_only(queries) if self.make_planner is None else planner.plan(queries, self.make_planner)

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, position, chunk_id, article_id, relevance, text of query_id, query."""
        return retrieval.hybrid(self.plans(queries), self.chunks, self.index, self.embed, k, self.config, rerank=self.rerank)


def contexts(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """id, items of each question's hits in order, headed by their citation where there is one."""
    heading = F.when(F.col("code").isNotNull(), F.concat_ws(", ", "article", "title"))
    item = F.struct("position", F.struct(F.col("text").alias("text"), heading.alias("heading")).alias("x"))
    rows = hits.join(cited, "article_id", "left").groupBy(F.col("query_id").alias("id"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias("items"))


def answer(engine: Engine, cited: DataFrame, make: Callable[[], models.Generator], k: int = 8, batch: int = 8, citation: CitationConfig = CitationConfig(), budget: ContextConfig = ContextConfig()) -> Callable[[DataFrame], DataFrame]:
    """Questions (id, question) -> records. cited: article_id, code, title, article."""

    def run(questions: DataFrame) -> DataFrame:
        asked = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
        hits = engine.hits(asked, k)
        chosen = citations.select(
            questions.select(F.col("id").alias("query_id"), "question"),
            citations.with_citations(hits.select("query_id", F.col("position").alias("rank"), F.col("relevance").alias("score"), "article_id"), cited), citation,
        )
        rows = questions.join(contexts(hits, cited), "id", "left")
        context = F.coalesce(submission.render_context(F.col("items"), budget), F.lit(""))
        prompts = rows.select("id", submission.answer_prompt(F.col("question"), context).alias("prompt"))
        answers = models.generate(prompts, make, batch)
        return questions.join(answers, "id").join(chosen.withColumnRenamed("query_id", "id"), "id").select("id", "question", "answer", "relevant_docs", "relevant_articles")

    return run
