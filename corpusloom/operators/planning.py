"""Query plans: guards on proposed variants, the policy that builds a plan, parsing of a planner's JSON, fallbacks.

A planner's answer is data: every check is a column, and a plan that fails one falls back to the original query with
a warning. Nothing raises for a bad answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Markers of the guards, kinds, and the fields of a planner's answer.
NEGATIONS = ("không được", "không phải", "không", "chưa")
DURATIONS = ("ngày", "tháng", "năm", "tuần", "giờ")
INTERROGATIVES = ("bao lâu", "thế nào", "khi nào", "là gì")
COMPANY_TYPES = (
    ("trách nhiệm hữu hạn một thành viên", "limited_liability_one_member"),
    ("trách nhiệm hữu hạn hai thành viên", "limited_liability_two_or_more"),
    ("trách nhiệm hữu hạn từ hai thành viên", "limited_liability_two_or_more"),
    ("công ty cổ phần", "joint_stock"),
    ("công ty hợp danh", "partnership"),
    ("doanh nghiệp tư nhân", "private_enterprise"),
    ("hợp tác xã", "cooperative"),
    ("trách nhiệm hữu hạn", "limited_liability"),
)
NUMBER = r"(?U)\b\d+(?:[./-]\w+)*"
ARTICLE_REFERENCE = r"(?U)\bđiều\s+\d"
QUERY_TYPES = ("exact_lookup", "legal_concept", "legal_situation", "ambiguous", "multi_issue")
INTENTS = ("deadline", "penalty", "procedure", "definition", "obligation", "eligibility", "unknown")
DOMAINS = ("enterprise", "labor", "tax", "social_insurance", "civil", "investment", "securities")
TEMPORAL_SCOPES = ("current", "historical")
WEIGHTS = {"original": 1.0, "semantic": 0.8, "scope": 0.7, "subquery": 0.75}
MAX_VARIANTS, MAX_SUBQUERIES, MAX_TERMS = 3, 2, 12
EVIDENCED = "struct<value:string,evidence:string>"
VARIANT = "struct<text:string,kind:string,reason:string>"
PAYLOAD = (
    f"struct<analysis:struct<intent:string,query_type:string,legal_domain:string,entities:array<{EVIDENCED}>,company_type:{EVIDENCED},article_number:{EVIDENCED},"
    f"clause_number:{EVIDENCED},document_number:{EVIDENCED},temporal_scope:string,must_terms:array<{EVIDENCED}>>,semantic_variants:array<{VARIANT}>,"
    "subqueries:array<struct<text:string,reason:string>>,lexical_terms:array<string>>"
)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(NUMBER), F.lit(0))


def keeps_negation(candidate: Column, original: Column) -> Column:
    ok = F.lit(True)
    for m in NEGATIONS:
        ok = ok & (~F.contains(F.lower(original), F.lit(m)) | F.contains(F.lower(candidate), F.lit(m)))
    return ok


def no_new_numbers(candidate: Column, original: Column) -> Column:
    return F.size(F.array_except(numbers(candidate), numbers(original))) == 0


def no_new_article(candidate: Column, article_number: Column) -> Column:
    return article_number.isNotNull() | ~F.lower(candidate).rlike(ARTICLE_REFERENCE)


def no_new_duration(candidate: Column, original: Column) -> Column:
    ok = F.lit(True)
    for unit in DURATIONS:
        ok = ok & (~F.contains(F.lower(candidate), F.lit(unit)) | F.contains(F.lower(original), F.lit(unit)))
    return ok


def company_type(c: Column) -> Column:
    """The first marker of the list that the text holds: the specific forms stand before the general one."""
    out = F.lit(None).cast("string")
    for marker, kind in reversed(COMPANY_TYPES):
        out = F.when(F.contains(F.lower(c), F.lit(marker)), kind).otherwise(out)
    return out


def keeps_company_type(candidate: Column, expected: Column) -> Column:
    found = company_type(candidate)
    limited = found.startswith("limited_liability")
    return F.when(expected.isNull(), True).when(expected == "limited_liability", F.coalesce(limited, F.lit(False))).otherwise(F.coalesce(found == expected, F.lit(False)))


def is_safe(candidate: Column, original: Column, article_number: Column, expected_type: Column) -> Column:
    return keeps_negation(candidate, original) & no_new_numbers(candidate, original) & no_new_article(candidate, article_number) & keeps_company_type(candidate, expected_type)


def is_grounded(candidate: Column, original: Column) -> Column:
    return no_new_numbers(candidate, original) & no_new_duration(candidate, original) & keeps_negation(candidate, original)


def quote_present(quote: Column, query: Column) -> Column:
    q = F.lower(T.squeeze(quote))
    return F.coalesce((q != "") & F.contains(F.lower(T.squeeze(query)), q), F.lit(False))


def terms_sound(terms: Column) -> Column:
    """No term of more than ten words, none with an interrogative."""
    asks = lambda t: F.exists(F.array(*[F.lit(x) for x in INTERROGATIVES]), lambda x: F.contains(F.lower(t), x))
    return F.forall(terms, lambda t: (T.word_count(t) <= 10) & ~asks(t))


def first_by(items: Column, key, limit: int) -> Column:
    """Items with a key not seen before, in order, at most ``limit``."""
    keep = lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, key), key(x)) == i + 1)
    return T.let(items, lambda xs: F.slice(keep(xs), 1, limit))


def select_variants(candidates: Column, original: Column, article_number: Column, expected_type: Column, limit: int) -> Column:
    """Safe candidates, distinct without regard to case and different from the original; scopes are recognised."""
    fold = lambda t: F.lower(T.strip(t))
    safe = F.filter(candidates, lambda v: is_safe(v["text"], original, article_number, expected_type) & (fold(v["text"]) != fold(original)))
    scoped = F.transform(
        first_by(safe, lambda v: fold(v["text"]), limit),
        lambda v: F.struct(v["text"].alias("text"), v["weight"].alias("weight"), v["kind"].alias("kind"), v["reason"].alias("reason"), F.when(v["kind"] == "scope", F.coalesce(v["scope"], company_type(v["text"]))).otherwise(v["scope"]).alias("scope")),
    )
    return scoped


def safe_terms(terms: Column, original: Column, accepted: Column) -> Column:
    """Lexical terms that occur in the original or an accepted variant and bring no new number or article."""
    ground = F.lower(F.concat_ws(" ", original, F.array_join(F.transform(accepted, lambda v: v["text"]), " ")))
    trimmed = F.transform(terms, T.strip)
    good = F.filter(trimmed, lambda t: (t != "") & no_new_numbers(t, original) & ~F.lower(t).rlike(ARTICLE_REFERENCE) & F.contains(ground, F.lower(t)))
    return first_by(good, F.lower, MAX_TERMS)


def evidenced(items: Column, query: Column) -> Column:
    """Distinct values of value/quote pairs; null if a value is empty or a quote isn't in the query."""
    sound = F.forall(items, lambda x: (F.coalesce(T.strip(x["value"]), F.lit("")) != "") & quote_present(x["evidence"], query))
    return F.when(sound, F.array_distinct(F.transform(items, lambda x: T.strip(x["value"]))))


def optional_evidenced(item: Column, query: Column, in_quote: bool = False) -> tuple[Column, Column]:
    """(value or null, whether it is valid)."""
    value = T.strip(item["value"])
    absent = item.isNull() | value.isNull() | F.lower(value).isin("null", "none")
    sound = quote_present(item["evidence"], query)
    if in_quote:
        sound = sound & F.contains(F.lower(item["evidence"]), F.lower(value))
    return F.when(~absent, value), absent | F.coalesce(sound & (value != ""), F.lit(False))


def variants_of(items: Column, query_type: Column) -> Column:
    kind = lambda v: F.when(v["kind"].isin("semantic", "scope"), v["kind"]).when(query_type == "ambiguous", "scope").otherwise("semantic")
    return F.transform(items, lambda v: F.struct(T.strip(v["text"]).alias("text"), F.when(kind(v) == "semantic", WEIGHTS["semantic"]).otherwise(WEIGHTS["scope"]).alias("weight"), kind(v).alias("kind"), v["reason"].alias("reason"), F.lit(None).cast("string").alias("scope")))


def subqueries_of(items: Column) -> Column:
    return F.transform(items, lambda v: F.struct(T.strip(v["text"]).alias("text"), F.lit(WEIGHTS["subquery"]).alias("weight"), F.lit("subquery").alias("kind"), v["reason"].alias("reason"), F.lit(None).cast("string").alias("scope")))


def draft(answers: DataFrame) -> DataFrame:
    """query_id, query, raw -> typed analysis and proposal with ``problem`` (null if sound)."""
    p = F.from_json(T.json_object(F.col("raw")), PAYLOAD)
    rows = answers.withColumn("query_text", T.query_text(F.col("query"))).withColumn("p", p)
    a, q = F.col("p.analysis"), F.col("query_text")
    company, company_ok = optional_evidenced(a["company_type"], q)
    refs = {n: optional_evidenced(a[f"{n}_number"], q, True) for n in ("article", "clause", "document")}
    rows = rows.select(
        "query_id", "query", "query_text", a["intent"].alias("intent"), a["query_type"].alias("query_type"), a["legal_domain"].alias("legal_domain"), a["temporal_scope"].alias("temporal_scope"),
        company.alias("company_type"), *[v.alias(f"{n}_number") for n, (v, _) in refs.items()], evidenced(F.coalesce(a["entities"], F.array().cast(f"array<{EVIDENCED}>")), q).alias("entities"),
        evidenced(F.coalesce(a["must_terms"], F.array().cast(f"array<{EVIDENCED}>")), q).alias("must_terms"),
        (company_ok & refs["article"][1] & refs["clause"][1] & refs["document"][1]).alias("evidence_ok"), a.isNotNull().alias("parsed"),
        *proposed(F.col("p"), a["query_type"]),
    )
    return rows.withColumn("analysis_problem", analysis_problem()).withColumn("expansion_problem", expansion_problem())


def proposed(p: Column, query_type: Column) -> list[Column]:
    """semantic, sub, lexical_terms of a parsed answer."""
    semantic = variants_of(F.coalesce(p["semantic_variants"], F.array().cast(f"array<{VARIANT}>")), query_type)
    sub = subqueries_of(F.coalesce(p["subqueries"], F.array().cast("array<struct<text:string,reason:string>>")))
    return [semantic.alias("semantic"), sub.alias("sub"), F.coalesce(p["lexical_terms"], T.empty_strings()).alias("lexical_terms")]


def with_expansion(drafts: DataFrame, raw: str = "raw") -> DataFrame:
    """Drafts with the expansion of a further answer (column raw) in place of their own."""
    p = F.from_json(T.json_object(F.col(raw)), PAYLOAD)
    keep = [F.col(c) for c in drafts.columns if c not in (raw, "semantic", "sub", "lexical_terms", "expansion_problem")]
    rows = drafts.withColumn("p", p).select(*keep, *proposed(F.col("p"), F.col("query_type")), F.col("p").isNotNull().alias("answered"))
    return rows.withColumn("expansion_problem", F.when(~F.col("answered"), "no JSON object").otherwise(expansion_problem())).drop("answered")


def has_reference() -> Column:
    return F.coalesce("article_number", "clause_number", "document_number").isNotNull()


def analysis_problem() -> Column:
    """The first rule that an analysis breaks, or null."""
    within = lambda c, allowed: F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    return (
        F.when(~F.col("parsed"), "no JSON object").when(~within("query_type", QUERY_TYPES), "unknown query type").when(~within("intent", INTENTS), "unknown intent")
        .when(~within("temporal_scope", TEMPORAL_SCOPES), "unknown temporal scope").when(~F.coalesce("legal_domain", F.lit("unknown")).isin("unknown", *DOMAINS), "unknown legal domain")
        .when(F.col("entities").isNull() | F.col("must_terms").isNull() | ~F.col("evidence_ok"), "evidence is not in the query")
        .when(~F.coalesce("company_type", F.lit(COMPANY_TYPES[0][1])).isin(*[kind for _, kind in COMPANY_TYPES]), "unknown company type")
        .when((F.col("query_type") == "exact_lookup") & ~has_reference(), "exact lookup without a reference").when(~terms_sound(F.concat("entities", "must_terms")), "too broad a term")
    )


def expansion_problem() -> Column:
    q = F.col("query_text")
    grounded = F.filter("semantic", lambda v: is_grounded(v["text"], q))
    distinct = F.size(F.array_distinct(F.transform(grounded, lambda v: F.lower(T.squeeze(v["text"])))))
    subs = F.size(F.filter("sub", lambda v: is_grounded(v["text"], q)))
    kind = F.col("query_type")
    return (
        F.when((kind == "exact_lookup") & ((F.size("semantic") > 0) | (F.size("sub") > 0)), "exact lookup with an expansion").when((kind == "ambiguous") & (distinct < 2), "fewer than two scopes")
        .when((kind == "multi_issue") & (subs < 1), "no subqueries").when(kind.isin("legal_concept", "legal_situation") & (distinct + subs < 1), "no expansion")
    )


def build(drafts: DataFrame) -> DataFrame:
    """query_id, query_type, semantic_queries, subqueries, lexical_terms, warning: the plan, or the original query alone."""
    q = F.col("query_text")
    expand = F.col("query_type") != "exact_lookup"
    none = F.filter("semantic", lambda v: F.lit(False))
    semantic = F.when(expand, select_variants(F.col("semantic"), q, F.col("article_number"), F.col("company_type"), MAX_VARIANTS)).otherwise(none)
    sub = F.when(expand, select_variants(F.col("sub"), q, F.col("article_number"), F.col("company_type"), MAX_SUBQUERIES)).otherwise(none)
    rows = drafts.withColumn("chosen", semantic).withColumn("chosen_sub", sub)
    policy = F.when((F.col("query_type") == "ambiguous") & (F.size("chosen") < 2), "fewer than two safe variants").when((F.col("query_type") == "multi_issue") & (F.size("chosen_sub") < 1), "no safe subqueries")
    rows = rows.withColumn("warning", F.coalesce("analysis_problem", "expansion_problem", policy))
    original = F.array(F.struct(q.alias("text"), F.lit(1.0).alias("weight"), F.lit("original").alias("kind"), F.lit("original_user_query").alias("reason"), F.lit(None).cast("string").alias("scope")))
    fine = F.col("warning").isNull()
    return rows.select(
        "query_id", F.col("query_text").alias("query"), F.when(F.col("analysis_problem").isNull(), F.col("query_type")).otherwise("legal_concept").alias("query_type"),
        F.when(F.col("analysis_problem").isNull(), F.col("intent")).otherwise("unknown").alias("intent"),
        F.when(fine, F.concat(original, "chosen")).otherwise(original).alias("semantic_queries"), F.when(fine, F.col("chosen_sub")).otherwise(none).alias("subqueries"),
        F.when(fine, safe_terms(F.col("lexical_terms"), q, F.concat("chosen", "chosen_sub"))).otherwise(T.empty_strings()).alias("lexical_terms"), "warning",
    )


def original_only(queries: DataFrame, warning: str | None = None) -> DataFrame:
    """Plans without a planner: the normalised query alone."""
    q = T.query_text(F.col("query"))
    kinds = "array<struct<text:string,weight:double,kind:string,reason:string,scope:string>>"
    one = F.array(F.struct(q.alias("text"), F.lit(1.0).alias("weight"), F.lit("original").alias("kind"), F.lit("original_user_query").alias("reason"), F.lit(None).cast("string").alias("scope")))
    return queries.select("query_id", q.alias("query"), F.lit("legal_concept").alias("query_type"), F.lit("unknown").alias("intent"), one.cast(kinds).alias("semantic_queries"), F.array().cast(kinds).alias("subqueries"), T.empty_strings().alias("lexical_terms"), F.lit(warning).cast("string").alias("warning"))


def variants(plans: DataFrame) -> DataFrame:
    """query_id, variant, text, weight, kind, scope, lexical_terms: semantic queries, then subqueries (which have no scope)."""
    unscoped = F.transform("subqueries", lambda v: v.withField("scope", F.lit(None).cast("string")))
    rows = plans.select("query_id", "query_type", "intent", "lexical_terms", F.posexplode(F.concat("semantic_queries", unscoped)).alias("variant", "v"))
    return rows.select("query_id", "query_type", "intent", "lexical_terms", "variant", "v.text", "v.weight", "v.kind", "v.scope")


def plan_violations(plans: DataFrame) -> DataFrame:
    """query_id, problem of plans that break an invariant."""
    first = F.get("semantic_queries", F.lit(0))
    every = F.concat("semantic_queries", "subqueries")
    problem = (
        F.when(F.size("semantic_queries") < 1, "no query").when((first["kind"] != "original") | (first["weight"] != 1.0), "the original does not come first with weight 1")
        .when(F.size("semantic_queries") > 4, "more than four semantic queries").when(F.size("subqueries") > 2, "more than two subqueries")
        .when(F.exists(every, lambda v: T.strip(v["text"]) == ""), "an empty query").when(F.exists(every, lambda v: (v["weight"] <= 0) | (v["weight"] > 1)), "a weight outside (0, 1]")
    )
    return plans.select("query_id", problem.alias("problem")).where("problem IS NOT NULL")
