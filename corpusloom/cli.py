"""Command line: python -m corpusloom.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Bm25Config, CitationConfig, ImportConfig, RetrievalConfig, TokenizerConfig


def session() -> SparkSession:
    return SparkSession.builder.appName("corpusloom").getOrCreate()


def ingest(a) -> None:
    from corpusloom.plans import corpus
    from corpusloom.sources import readers

    spark = session()
    print(corpus.ingest(spark, readers.articles(spark, a.articles, a.format, a.limit), a.out, fmt=a.out_format))


def build_index(a) -> None:
    from corpusloom.plans import corpus
    from corpusloom.sources import readers

    spark = session()
    phrases = readers.phrases(spark, a.phrase_file) if a.phrase_file else None
    chunks = spark.read.parquet(a.chunks).withColumn("doc_id", F.xxhash64("article_id", "ordinal"))
    chunks = chunks if a.limit is None else chunks.limit(a.limit)
    config = TokenizerConfig(phrases=phrases, phrase_boost=a.phrase_boost, repair_mojibake=not a.no_repair_mojibake)
    corpus.build_index(chunks, a.out, Bm25Config(a.k1, a.b), config).stats.show()


def load_vectors(a) -> None:
    from corpusloom.plans import corpus
    from corpusloom.sources.writers import Collection

    spark = session()
    config = ImportConfig(dim=a.dim, start_file=a.start_file, recreate=a.recreate)
    print(corpus.import_vectors(spark, a.shards, Collection(spark, a.collection, a.dim), config))


def audit(a) -> None:
    from corpusloom.plans import corpus
    from corpusloom.sources.writers import Collection

    spark = session()
    corpus.audit_reports(spark.read.parquet(a.chunks), Collection(spark, a.collection, a.dim).read(), a.out).show()


def engine_of(a, spark: SparkSession):
    """What the options name: stand-in models, an index, passages with their vectors."""
    from corpusloom.operators import bm25, models
    from corpusloom.plans.answering import Engine

    baseline = a.mode == "baseline"
    embed = None if a.disable_dense else models.embedder_udf(lambda: models.HashingEmbedder(a.dim))
    chunks = spark.read.parquet(a.chunks).withColumn("doc_id", F.xxhash64("article_id", "ordinal"))
    chunks = chunks if embed is None else chunks.withColumn("embedding", embed("text"))
    index = None if baseline or a.disable_bm25 or not a.index else bm25.load_index(spark, a.index)
    rerank = None if baseline or a.disable_reranker else models.reranker_udf(models.OverlapReranker)
    config = RetrievalConfig(
        a.bm25_weight, a.per_query_top_k, a.oversample_factor, a.candidate_pool_size, a.scope_candidates_per_branch, a.max_chunks_per_article, a.ambiguous_max_chunks_per_article, a.scope_relevance_margin
    )
    return Engine(chunks, index, embed, rerank, None if baseline else models.TemplatePlanner, config)


def plan(a) -> None:
    """One query's plan: by the planner, by its answer given as --raw, or the query alone."""
    from corpusloom.operators import models, planning
    from corpusloom.plans import planner

    rows = session().createDataFrame([(0, a.query, a.raw)], "query_id long, query string, raw string")
    if a.raw:
        plans = planning.build(planning.draft(rows))
    else:
        plans = planning.original_only(rows) if a.mode == "baseline" else planner.plan(rows.drop("raw"), models.TemplatePlanner)
    print("\n".join(plans.toJSON().take(1)))


def retrieve(a) -> None:
    """Plan a query and search for it: one JSON object with the plan and its hits."""
    from corpusloom.plans import retrieval
    from corpusloom.sources.scratch import cut

    spark = session()
    engine = engine_of(a, spark)
    plans = cut(engine.plans(spark.createDataFrame([(0, a.query)], "query_id long, query string")), "plan")
    hits = retrieval.hybrid(plans, engine.chunks, engine.index, engine.embed, a.top_k, engine.config, rerank=engine.rerank)
    found = [json.loads(x) for x in hits.orderBy("position").toJSON().collect()]  # at most top_k
    print(json.dumps({"query_plan": json.loads(plans.toJSON().first()), "hits": found}, ensure_ascii=False, indent=2))


def cutoffs_of(text: str) -> list[int]:
    """A comma-separated list of positive numbers, in order and without repeats."""
    try:
        cutoffs = sorted({int(x) for x in text.split(",") if x.strip()})
    except ValueError:
        cutoffs = []
    if not cutoffs or cutoffs[0] < 1:
        raise SystemExit("--cutoffs takes positive numbers, separated by commas")
    return cutoffs


def evaluate_retrieval(a) -> None:
    """Retrieve for every case of a test set and measure."""
    from corpusloom.operators import metrics
    from corpusloom.sources import readers, writers

    spark, cutoffs = session(), cutoffs_of(a.cutoffs)
    cases = readers.test_cases(spark, a.cases)
    hits = engine_of(a, spark).hits(cases.select(F.col("case_id").alias("query_id"), "query"), cutoffs[-1])
    found = readers.case_hits(cases, hits.select(F.col("query_id").alias("case_id"), F.col("position").alias("rank"), "chunk_id", "article_id"))
    print(writers.metrics_table(metrics.ranking(found, cutoffs).orderBy("cutoff")))


def generate(a) -> None:
    """Answer all questions that have no saved answer, in slices, then check and deliver."""
    from corpusloom.operators import citations, models
    from corpusloom.plans import answering
    from corpusloom.sources import readers, writers
    from corpusloom.sources.scratch import cut
    from corpusloom.streaming import answers

    spark = session()
    cited = cut(citations.resolve(spark.read.parquet(a.articles)), "citations")
    run = answering.answer(engine_of(a, spark), cited, models.ExtractiveGenerator, a.top_k, a.batch, CitationConfig(tuple(a.exact), tuple(a.simple), tuple(a.multi)))
    records = answers.generate(spark, readers.questions(spark, a.questions), a.work, readers.RECORD, run, a.checkpoint_interval, lambda done, of: print(f"{done} of {of}"))
    print(writers.submission(records, a.out))


def postprocess(a) -> None:
    from corpusloom.operators import citations
    from corpusloom.sources import readers, writers

    config = CitationConfig(tuple(a.exact), tuple(a.simple), tuple(a.multi))
    records = readers.records(session(), a.records)
    filtered = citations.postprocess(records, config)
    print(writers.submission(filtered, a.out))
    for r in citations.before_after(records, filtered).collect():
        print(f"{r['field']}: {r['before']} -> {r['after']}")


def validate(a) -> None:
    from corpusloom.operators import submission
    from corpusloom.sources import readers, writers

    spark = session()
    submission.validate(readers.records(spark, a.records), readers.questions(spark, a.questions))
    if a.zip:
        writers.check_zip(a.zip, Path(a.records).read_bytes(), Path(a.records).name)
    print("valid")


def score(a) -> None:
    from corpusloom.operators import metrics
    from corpusloom.sources import readers, writers

    spark = session()
    out = metrics.answer_sets(readers.labels(spark, a.records), readers.labels(spark, a.gold))
    print("\n".join(out.toJSON().collect()) if a.json else writers.metrics_table(out))


QUOTAS: list = [("--exact", [1, 1]), ("--simple", [2, 2]), ("--multi", [3, 5])]
SEARCH: list = [
    ("chunks",), ("--index", str), ("--mode", "auto"), ("--dim", 64), ("--per-query-top-k", 20), ("--bm25-weight", 0.7), ("--oversample-factor", 5), ("--candidate-pool-size", 50), ("--scope-candidates-per-branch", 5),
    ("--max-chunks-per-article", 2), ("--ambiguous-max-chunks-per-article", 1), ("--scope-relevance-margin", 0.15), ("--disable-bm25", False), ("--disable-dense", False), ("--disable-reranker", False),
]
OPTIONS: dict = {
    ingest: [("articles",), ("out",), ("--format", "parquet"), ("--out-format", "parquet"), ("--limit", int)],
    build_index: [("chunks",), ("out",), ("--limit", int), ("--k1", 1.5), ("--b", 0.75), ("--phrase-file", str), ("--phrase-boost", 1), ("--no-repair-mojibake", False)],
    load_vectors: [("shards",), ("collection",), ("--dim", 1024), ("--start-file", int), ("--recreate", False)],
    audit: [("chunks",), ("collection",), ("out",), ("--dim", 1024)],
    plan: [("query",), ("--raw", str), ("--mode", "auto")],
    retrieve: [("query",), *SEARCH, ("--top-k", 10)],
    evaluate_retrieval: [("cases",), *SEARCH, ("--cutoffs", "1,3,5,10,20")],
    generate: [("questions",), ("articles",), ("work",), ("out",), *SEARCH, ("--top-k", 8), ("--batch", 8), ("--checkpoint-interval", 100), *QUOTAS],
    postprocess: [("records",), ("out",), *QUOTAS],
    validate: [("records",), ("questions",), ("--zip", str)],
    score: [("records",), ("gold",), ("--json", False)],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    commands = top.add_subparsers(required=True)
    for run, options in OPTIONS.items():
        p = commands.add_parser(run.__name__.replace("_", "-"))
        p.set_defaults(run=run)
        for name, *default in options:
            if not default:
                p.add_argument(name)
            elif default[0] is False:
                p.add_argument(name, action="store_true")
            elif isinstance(default[0], type):
                p.add_argument(name, type=default[0])
            elif isinstance(default[0], list):
                p.add_argument(name, type=int, nargs=2, default=default[0])
            else:
                p.add_argument(name, type=type(default[0]), default=default[0])
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
