"""Planning whole batches of queries with a language model: one call to analyse, one to expand, one repair of each.

Every call is a pass of the model over the rows that need it, and its answers are written before anything reads them,
so no answer is asked for twice. A query whose analysis stays invalid is searched as it is; one whose expansion stays
invalid keeps its analysis and is searched as it is. Exact lookups aren't expanded: their terms are the lexical ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import models, planning
from corpusloom.sources.scratch import cut


def analysis_prompt(query: Column, reason: Column | None = None) -> Column:
    parts = [F.lit("ANALYSE this query; answer with one JSON object.\n"), query]
    if reason is not None:
        parts += [F.lit("\nThe answer before was rejected: "), reason]
    return F.concat(*parts)


def expansion_prompt(query: Column, analysis: Column, reason: Column | None = None) -> Column:
    parts = [F.lit("EXPAND this query; answer with one JSON object and never with the query itself.\n"), query, F.lit("\nChecked analysis: "), analysis]
    if reason is not None:
        parts += [F.lit("\nThe answer before was rejected: "), reason]
    return F.concat(*parts)


def analyse(queries: DataFrame, make: Callable[[], models.Generator], batch: int = 8) -> DataFrame:
    """Drafts (see planning.draft) of query_id, query: rejected analyses are repaired once."""
    asked = queries.select("query_id", "query", analysis_prompt(T.query_text(F.col("query"))).alias("prompt"))
    first = planning.draft(cut(models.respond(asked, make, batch), "analyses"))
    rejected = first.where("analysis_problem IS NOT NULL")
    again = rejected.select("query_id", "query", analysis_prompt(F.col("query_text"), F.col("analysis_problem")).alias("prompt"))
    repaired = planning.draft(cut(models.respond(again, make, batch), "repaired-analyses"))
    still = F.when(F.col("analysis_problem").isNotNull(), "analysis remained invalid after one repair")
    return first.where("analysis_problem IS NULL").unionByName(repaired.withColumn("analysis_problem", still))


def expand(drafts: DataFrame, make: Callable[[], models.Generator], batch: int = 8) -> DataFrame:
    """Drafts with their expansion, repaired once where it is rejected."""
    exact = F.col("query_type") == "exact_lookup"
    sound = F.col("analysis_problem").isNull()
    none = F.filter("semantic", lambda v: F.lit(False))
    lookups = drafts.where(sound & exact).withColumns({"semantic": none, "sub": none, "lexical_terms": F.col("must_terms"), "expansion_problem": F.lit(None).cast("string")})
    todo = drafts.where(sound & ~exact)
    context = F.to_json(F.struct("intent", "query_type", "legal_domain", "entities", "company_type", "temporal_scope", "must_terms"), {"ignoreNullFields": "false"})
    asked = todo.withColumn("prompt", expansion_prompt(F.col("query_text"), context))
    first = planning.with_expansion(cut(models.respond(asked, make, batch), "expansions"))
    rejected = first.where("expansion_problem IS NOT NULL")
    again = rejected.withColumn("prompt", expansion_prompt(F.col("query_text"), context, F.col("expansion_problem")))
    repaired = planning.with_expansion(cut(models.respond(again, make, batch), "repaired-expansions"))
    still = F.when(F.col("expansion_problem").isNotNull(), "expansion remained invalid after one repair")
    done = first.where("expansion_problem IS NULL").unionByName(repaired.withColumn("expansion_problem", still))
    return drafts.where(~sound).unionByName(lookups.select(*drafts.columns)).unionByName(done.select(*drafts.columns))


def plan(queries: DataFrame, make: Callable[[], models.Generator], batch: int = 8) -> DataFrame:
    """Plans of query_id, query, as planning.build gives them."""
    return planning.build(expand(cut(analyse(queries, make, batch), "drafts"), make, batch))
