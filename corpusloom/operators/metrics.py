"""Quality measures of rankings and of answer sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let


def relevance_ids(field: Column, chunk_id: Column, article_id: Column) -> Column:
    """What a case compares: chunks, or articles (a missing one is the empty string)."""
    return F.when(field == "chunk_id", chunk_id).otherwise(F.coalesce(article_id, F.lit("")))


def recall_at(retrieved: Column, relevant: Column, k: Column) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.size(F.array_distinct(relevant))


def reciprocal_rank_at(retrieved: Column, relevant: Column, k: Column) -> Column:
    ranks = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / (i + 1)))
    return F.coalesce(F.array_max(ranks), F.lit(0.0))


def ranking_by_case(cases: DataFrame, cutoffs: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    """case_id, cutoff, recall, rr. cases: case_id, retrieved (ordered ids, null for none), relevant."""
    ks = sorted({int(c) for c in cutoffs})
    if not ks or ks[0] < 1:
        raise ValueError("cutoffs must be positive")
    rows = cases.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>"))).withColumn("cutoff", F.explode(F.array(*[F.lit(k) for k in ks])))
    return rows.select("case_id", "cutoff", recall_at(F.col("retrieved"), F.col("relevant"), F.col("cutoff")).alias("recall"), reciprocal_rank_at(F.col("retrieved"), F.col("relevant"), F.col("cutoff")).alias("rr"))


def ranking(cases: DataFrame, cutoffs: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    return ranking_by_case(cases, cutoffs).groupBy("cutoff").agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


def ranking_of_hits(cases: DataFrame, relevant_hits: DataFrame, cutoffs: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    """The same means from joins: cases with the number of their relevant items (case_id, n_relevant), and the ranks at which
    such items were found (case_id, rank). No list of a case's items is made."""
    ks = F.explode(F.array(*[F.lit(k) for k in sorted({int(c) for c in cutoffs})])).alias("cutoff")
    ranks = relevant_hits.groupBy("case_id").agg(F.collect_list("rank").alias("ranks"))  # at most the largest cutoff's number
    rows = cases.join(ranks, "case_id", "left").select("n_relevant", F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), ks)
    near = F.filter("ranks", lambda r: r <= F.col("cutoff"))
    return rows.groupBy("cutoff").agg(F.avg(F.size(near) / F.col("n_relevant")).alias("recall"), F.avg(F.coalesce(1.0 / F.array_min(near), F.lit(0.0))).alias("mrr"))


def f2(p: Column, r: Column) -> Column:
    return F.when(4 * p + r > 0, 5 * p * r / (4 * p + r)).otherwise(0.0)


def set_scores(predicted: Column, gold: Column) -> Column:
    """struct<precision, recall, f2> of two sets; two empty ones agree fully. Sets are compared once, however often a size is used."""
    sizes = F.struct(F.size(F.array_intersect(predicted, gold)).cast("double").alias("h"), F.size(F.array_distinct(predicted)).alias("n"), F.size(F.array_distinct(gold)).alias("m"))

    def shares(s: Column) -> Column:
        both = (s["n"] == 0) & (s["m"] == 0)
        p = F.when(both, 1.0).when(s["n"] == 0, 0.0).otherwise(F.try_divide(s["h"], s["n"]))
        r = F.when(both, 1.0).when(s["m"] == 0, 0.0).otherwise(F.try_divide(s["h"], s["m"]))
        return F.struct(p.alias("precision"), r.alias("recall"))

    return let(let(sizes, shares), lambda x: F.struct(x["precision"].alias("precision"), x["recall"].alias("recall"), f2(x["precision"], x["recall"]).alias("f2")))


def answer_sets(predicted: DataFrame, gold: DataFrame, fields: Sequence[str] = ("relevant_docs", "relevant_articles")) -> DataFrame:
    """field, precision, recall, f2: means over the gold cases; a missing prediction is an empty set, further ones don't count."""
    joined = gold.select("id", *[F.array_distinct(f).alias(f"gold_{f}") for f in fields]).join(predicted.select("id", *[F.array_distinct(f).alias(f) for f in fields]), "id", "left")
    empty = F.array().cast("array<string>")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), set_scores(F.coalesce(F.col(f), empty), F.coalesce(F.col(f"gold_{f}"), empty)).alias("s")) for f in fields])
    return joined.select(F.explode(rows).alias("x")).groupBy("x.field").agg(*[F.avg(f"x.s.{m}").alias(m) for m in ("precision", "recall", "f2")])
