"""Queries for planning, citations and records. Their texts are put together from the tables' keys: the tables hold
invented prose, so statutes and questions about them have to be built; what must come out is said in SQL over the same keys."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import citations, models, planning, submission
from corpusloom.plans import planner
from corpusloom.plans.catalog_functions import pick, sql_pick
from corpusloom.plans.registry import long, query, table


def text_of(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---------------------------------------------------------------- guards

ASKED = ["không được góp vốn vào công ty cổ phần", "mức phạt 30/2020 theo điều 5", "thời hạn 10 ngày", "doanh nghiệp tư nhân là gì", "Công ty trách nhiệm hữu hạn một thành viên", "vốn điều lệ"]
PROPOSED = [
    "không được góp vốn", "được góp vốn công ty cổ phần", "mức phạt 30/2020", "mức phạt theo điều 5", "thời hạn 10 tháng", "công ty trách nhiệm hữu hạn hai thành viên trở lên", "trách nhiệm hữu hạn",
    "Vốn  điều lệ", "điều 47 của hợp tác xã", "công ty cổ phần", "doanh nghiệp tư nhân là",
]
COMPANY = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{marker}') THEN '{kind}'" for marker, kind in planning.COMPANY_TYPES) + " END"
NUMBERS = "regexp_extract_all(lower({0}), '\\b\\d+(?:[./-]\\w+)*')"
FOUND = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
KEEPS = " AND ".join(f"(NOT contains(lower(o), '{m}') OR contains(lower(c), '{m}'))" for m in planning.NEGATIONS)
GUARDS = f"""WITH t AS (SELECT o_orderkey, {sql_pick(ASKED, "o_orderkey")} AS o, {sql_pick(PROPOSED, "o_custkey")} AS c FROM orders),
g AS (SELECT o_orderkey, {KEEPS} AS negation, len(list_filter({NUMBERS.format("c")}, lambda x: NOT list_contains({NUMBERS.format("o")}, x))) = 0 AS numbers, NOT regexp_matches(lower(c), '(^|[^\\p{{L}}])điều\\s+\\d') AS article,
{" AND ".join(f"(NOT contains(lower(c), '{u}') OR contains(lower(o), '{u}'))" for u in planning.DURATIONS)} AS duration, {COMPANY.format("c")} AS company, {COMPANY.format("o")} AS expected, contains({FOUND.format("o")}, {FOUND.format("c")}) AS quoted FROM t),
k AS (SELECT *, CASE WHEN expected IS NULL THEN true WHEN expected = 'limited_liability' THEN coalesce(starts_with(company, 'limited_liability'), false) ELSE coalesce(company = expected, false) END AS company_kept FROM g)
"""


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", pick(ASKED, F.col("o_orderkey")).alias("o"), pick(PROPOSED, F.col("o_custkey")).alias("c"))


@query(GUARDS + "SELECT o_orderkey, negation, numbers, article, duration, company, company_kept, quoted FROM k")
def expansion_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o"), F.col("c")
    return guarded(spark, sf_dir).select(
        "o_orderkey", planning.keeps_negation(c, o).alias("negation"), planning.no_new_numbers(c, o).alias("numbers"), planning.no_new_article(c, F.lit(None)).alias("article"), planning.no_new_duration(c, o).alias("duration"),
        planning.company_type(c).alias("company"), planning.keeps_company_type(c, planning.company_type(o)).alias("company_kept"), planning.quote_present(c, o).alias("quoted"),
    )


@query(GUARDS + "SELECT o_orderkey, negation AND numbers AND article AND company_kept AS safe, numbers AND duration AND negation AS grounded FROM k")
def expansion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o"), F.col("c")
    return guarded(spark, sf_dir).select("o_orderkey", planning.is_safe(c, o, F.lit(None), planning.company_type(o)).alias("safe"), planning.is_grounded(c, o).alias("grounded"))


TERMS = ["vốn điều lệ", "thời hạn bao lâu", "một hai ba bốn năm sáu bảy tám chín mười", "một hai ba bốn năm sáu bảy tám chín mười mười", "Là gì"]


@query(f"""WITH t AS (SELECT o_orderkey, {sql_pick(TERMS, "o_orderkey")} AS a, {sql_pick(TERMS, "o_custkey")} AS b FROM orders)
SELECT o_orderkey, {" AND ".join(f"len(string_split({x}, ' ')) <= 10 AND NOT regexp_matches(lower({x}), 'bao lâu|thế nào|khi nào|là gì')" for x in "ab")} AS sound FROM t""")
def sound_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(pick(TERMS, F.col("o_orderkey")), pick(TERMS, F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", planning.terms_sound(terms).alias("sound"))


QUOTES = ["vốn", "điều lệ", "không có", ""]


@query(f"""WITH t AS (SELECT o_orderkey, {sql_pick(QUOTES, "o_orderkey")} AS a, {sql_pick(QUOTES, "o_custkey")} AS b FROM orders), f AS (SELECT *, a IN ('vốn', 'điều lệ') AS fa, b IN ('vốn', 'điều lệ') AS fb FROM t)
SELECT o_orderkey, CASE WHEN fa AND fb THEN 'x' || CASE WHEN o_custkey % 2 = 0 THEN ',y' ELSE '' END END AS listed, CASE WHEN o_custkey % 3 > 0 THEN 'vốn' END AS optional, o_custkey % 3 = 0 OR a = 'vốn' AS valid
FROM f JOIN (SELECT o_orderkey, o_custkey FROM orders) USING (o_orderkey)""")
def evidenced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j, asked = F.col("o_orderkey"), F.col("o_custkey"), F.lit("Vốn  điều lệ là gì")
    one = lambda value, quote: F.struct(F.lit(value).alias("value") if isinstance(value, str) else value.alias("value"), quote.alias("evidence"))
    items = F.array(one(" x ", pick(QUOTES, i)), one(F.when(j % 2 == 0, "y").otherwise("x"), pick(QUOTES, j)))
    value, valid = planning.optional_evidenced(one(F.when(j % 3 > 0, "vốn").otherwise("null"), pick(QUOTES, i)), asked, True)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(planning.evidenced(items, asked), ",").alias("listed"), value.alias("optional"), valid.alias("valid"))


# ---------------------------------------------------------------- plans

def planned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), text_of("vốn điều lệ  số ", F.col("n_nationkey")).alias("query"), "n_nationkey")


def drafted(query_type: str, variants: Sequence[tuple[str, str]] = (), subs: Sequence[str] = (), terms: Sequence[str] = ()) -> str:
    """A planner's answer; # stands for the query's number."""
    analysis = {"intent": "definition", "query_type": query_type, "entities": [], "temporal_scope": "current", "must_terms": []}
    parts = {"analysis": analysis, "semantic_variants": [{"text": t, "kind": k, "reason": "r"} for t, k in variants], "subqueries": [{"text": t, "reason": "r"} for t in subs], "lexical_terms": list(terms)}
    return json.dumps(parts, ensure_ascii=False)


ANSWERS = [
    "```json\n" + drafted("legal_concept", [("khái niệm vốn điều lệ số #", "semantic"), ("KHÁI NIỆM vốn điều lệ số #", "semantic"), ("vốn 99", "semantic")], terms=["vốn điều lệ", "điều 5", "mới", "Vốn điều lệ"]) + "\n```",
    "not json",
    drafted("multi_issue", subs=["vốn", "điều lệ", "số #"]),
    drafted("exact_lookup"),
    drafted("ambiguous", [("vốn điều lệ số # công ty cổ phần", "scope"), ("vốn điều lệ số # hợp tác xã", "scope")]),
]


@query("""WITH t AS (SELECT n_nationkey::BIGINT AS k, 'vốn điều lệ số ' || n_nationkey AS q FROM nation)
SELECT k AS query_id, 0::BIGINT AS variant, q AS text, 1.0::DOUBLE AS weight, 'original' AS kind, NULL AS scope, CASE WHEN k % 5 = 0 THEN 'vốn điều lệ' ELSE '' END AS terms FROM t
UNION ALL SELECT k, 1, 'khái niệm ' || q, 0.8, 'semantic', NULL, 'vốn điều lệ' FROM t WHERE k % 5 = 0
UNION ALL SELECT k, 1, 'vốn', 0.75, 'subquery', NULL, '' FROM t WHERE k % 5 = 2 UNION ALL SELECT k, 2, 'điều lệ', 0.75, 'subquery', NULL, '' FROM t WHERE k % 5 = 2
UNION ALL SELECT k, 1, q || ' công ty cổ phần', 0.7, 'scope', 'joint_stock', '' FROM t WHERE k % 5 = 4 UNION ALL SELECT k, 2, q || ' hợp tác xã', 0.7, 'scope', 'cooperative', '' FROM t WHERE k % 5 = 4""")
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planned_text(spark, sf_dir).withColumn("raw", F.replace(pick(ANSWERS, F.col("n_nationkey")), F.lit("#"), F.col("n_nationkey").cast("string")))
    return planning.variants(planning.build(planning.draft(rows))).select("query_id", long("variant"), "text", "weight", "kind", "scope", F.array_join("lexical_terms", ",").alias("terms"))


class FaultyPlanner(models.TemplatePlanner):
    """Wrong at first, or always, for some queries."""

    def answer(self, prompt: str, query: str) -> str:
        number, again = int(query.split()[-1]), "rejected" in prompt
        if prompt.startswith("EXPAND"):
            return "{}" if number % 8 == 6 or number % 4 == 2 and not again else super().answer(prompt, query)
        return "no JSON" if number % 4 == 3 or number % 4 == 1 and not again else super().answer(prompt, query)


@query("""SELECT n_nationkey::BIGINT AS query_id, 'legal_concept' AS query_type, CASE WHEN n_nationkey % 4 = 3 OR n_nationkey % 8 = 6 THEN 1 ELSE 2 END::BIGINT AS queries,
CASE WHEN n_nationkey % 4 = 3 THEN 'analysis remained invalid after one repair' WHEN n_nationkey % 8 = 6 THEN 'expansion remained invalid after one repair' END AS warning,
CASE WHEN n_nationkey % 4 = 3 OR n_nationkey % 8 = 6 THEN '' ELSE 'vốn điều lệ số ' || n_nationkey END AS terms FROM nation""")
def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = planner.plan(planned_text(spark, sf_dir), FaultyPlanner, 4)
    return plans.select("query_id", "query_type", F.size("semantic_queries").cast("long").alias("queries"), "warning", F.array_join("lexical_terms", ",").alias("terms"))


class LookupPlanner(models.TemplatePlanner):
    """Finds a reference in every query; it is never asked to expand."""

    def answer(self, prompt: str, query: str) -> str:
        if prompt.startswith("EXPAND"):
            raise ValueError("exact lookups aren't expanded")
        number = query.split()[-1]
        analysis = {"intent": "definition", "query_type": "exact_lookup", "entities": [], "temporal_scope": "current", "article_number": {"value": number, "evidence": f"Điều {number}"}, "must_terms": [{"value": "vốn", "evidence": "vốn"}]}
        return json.dumps({"analysis": analysis}, ensure_ascii=False)


@query("SELECT n_nationkey::BIGINT AS query_id, 'vốn theo Điều ' || n_nationkey AS query, 'exact_lookup' AS query_type, 'definition' AS intent, 1::BIGINT AS queries, 'vốn' AS terms FROM nation")
def exact_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), text_of("vốn theo điều", F.col("n_nationkey")).alias("query"))
    plans = planner.plan(asked, LookupPlanner)
    return plans.select("query_id", "query", "query_type", "intent", F.size("semantic_queries").cast("long").alias("queries"), F.array_join("lexical_terms", ",").alias("terms"))


@query("""SELECT n_nationkey::BIGINT AS query_id, 'what is ' || n_name AS text, 0::BIGINT AS variant, 'original' AS kind, 1.0::DOUBLE AS weight,
'{"query_id":' || n_nationkey || ',"query":"what is ' || n_name || '","query_type":"legal_concept","intent":"unknown","semantic_queries":[{"text":"what is ' || n_name || '","weight":1.0,"kind":"original","reason":"original_user_query"}],"subqueries":[],"lexical_terms":[],"warning":"none"}' AS record FROM nation""")
def original_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = planning.original_only(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), text_of(" what  is ", F.col("n_name")).alias("query")), "none")
    records = plans.select("query_id", submission.to_json_record(*plans.columns).alias("long"), F.to_json(F.struct(*plans.columns)).alias("record")).drop("long")
    return planning.variants(plans).join(records, "query_id").select("query_id", "text", long("variant"), "kind", "weight", "record")


@query("""SELECT n_nationkey::BIGINT AS query_id, ['the original does not come first with weight 1', 'an empty query', 'more than four semantic queries', 'more than two subqueries', 'a weight outside (0, 1]'][n_nationkey % 6] AS problem FROM nation WHERE n_nationkey % 6 > 0""")
def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = planning.original_only(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("query")))
    i, first = F.col("query_id") % 6, F.get("semantic_queries", F.lit(0))
    variant = first.withField("kind", F.lit("semantic"))
    semantic = F.when(i == 1, F.array(first.withField("weight", F.lit(0.5)))).when(i == 2, F.array(first, variant.withField("text", F.lit(" ")))).when(i == 3, F.concat(F.array(first), F.array_repeat(variant, 4)))
    semantic = semantic.when(i == 5, F.array(first, variant.withField("weight", F.lit(1.5)))).otherwise(F.col("semantic_queries"))
    return planning.plan_violations(plans.withColumns({"semantic_queries": semantic, "subqueries": F.when(i == 4, F.array_repeat(first, 3)).otherwise(F.col("subqueries"))}))


@query("SELECT n_nationkey::BIGINT AS id, 'công ty trách nhiệm hữu hạn số ' || n_nationkey || ' theo Khoản ' || n_nationkey || ' Điều ' || n_nationkey || '.a, Điểm đ và 12' || n_nationkey || '/2020/NĐ-CP, bảo hiểm xã hội' AS normal FROM nation")
def normalised_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = text_of(" công ty  TNHH số ", F.col("n_nationkey"), " theo khoản", F.col("n_nationkey"), " điều", F.col("n_nationkey"), ".a, điểm đ và 12", F.col("n_nationkey"), " / 2020 /nđ - CP, bhxh\n")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), T.query_text(asked).alias("normal"))


# ---------------------------------------------------------------- citations

def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    article, code = F.col("o_orderkey") % 50 + 1, F.col("o_custkey") % 20 + 1
    note = (
        F.when(F.col("o_orderkey") % 4 == 0, text_of("(Điều ", article, " Luật số ", code, "/2004/QH11 Tên ", F.repeat(F.lit("x"), (F.col("o_orderkey") % 5 + 1).cast("int")), " ngày 03/12/2004)"))
        .when(F.col("o_orderkey") % 4 == 1, text_of("(Điều ", article, " Luật số ", code, "/2004/QH11, có hiệu lực)")).when(F.col("o_orderkey") % 4 == 2, text_of("(Điều ", article, "a.2 Nghị định ", code, "/2020/NĐ-CP về xử phạt của Chính phủ)"))
        .otherwise("no citation here")
    )
    return table(spark, sf_dir, "orders").select(text_of("a", F.col("o_orderkey")).alias("article_id"), note.alias("source_note_text"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 4 AS kind, o_custkey % 20 + 1 AS code, o_orderkey % 50 + 1 AS article, 'Tên ' || repeat('x', (o_orderkey % 5 + 1)::INT) AS own FROM orders),
best AS (SELECT code, arg_max(own, length(own)) AS best FROM s WHERE kind = 0 GROUP BY code)
SELECT 'a' || o_orderkey AS article_id, CASE WHEN kind < 2 THEN code || '/2004/QH11' ELSE code || '/2020/NĐ-CP' END AS code,
CASE kind WHEN 0 THEN 'Luật ' || code || '/2004/QH11 ' || own WHEN 1 THEN 'Luật ' || code || '/2004/QH11' || coalesce(' ' || best, '') ELSE 'Nghị định ' || code || '/2020/NĐ-CP về xử phạt' END AS title,
'Điều ' || article || CASE WHEN kind = 2 THEN 'a.2' ELSE '' END AS article FROM s LEFT JOIN best USING (code) WHERE kind < 3""")
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.resolve(notes(spark, sf_dir)).select("article_id", "code", "title", "article")


QUESTIONS = ["Khoản 2 Điều 47 quy định gì? (", "Hỗ trợ doanh nghiệp nhỏ và vừa, số ", "Thủ tục ra sao và phải nộp gì? (", "Theo 15/2020/NĐ-CP thì sao, số ", "Thuế đất và phí, số "]
ASKS = f"SELECT o_orderkey, lower({sql_pick(QUESTIONS, 'o_orderkey')} || o_custkey || '?') AS q FROM orders"
PROFILE = """CASE WHEN regexp_matches(q, '(điều|khoản|điểm)\\s+\\d|\\d{1,5}/\\d{4}/[a-zđ]') THEN 'exact_lookup'
WHEN regexp_matches(replace(q, 'nhỏ và vừa', 'nhỏ vừa'), '(như thế nào|ra sao)\\s+và\\s+|và\\s+(phải|nộp)\\s|về\\s+[^?]{3,80}\\s+và\\s+[^?]{3,80}\\?|thuế\\s[^?]*\\svà\\s') THEN 'multi_issue' ELSE 'simple' END"""


@query(f"""WITH t AS ({ASKS}), p AS (SELECT o_orderkey, {PROFILE} AS profile FROM t)
SELECT o_orderkey, profile, CASE profile WHEN 'exact_lookup' THEN 1 WHEN 'simple' THEN 2 ELSE 3 END::BIGINT AS max_docs, CASE profile WHEN 'exact_lookup' THEN 1 WHEN 'simple' THEN 2 ELSE 5 END::BIGINT AS max_articles FROM p""")
def question_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(pick(QUESTIONS, F.col("o_orderkey")), F.col("o_custkey").cast("string"), F.lit("?"))
    lim = citations.limits(asked)
    return table(spark, sf_dir, "orders").select("o_orderkey", citations.profile(asked).alias("profile"), lim["max_docs"].cast("long").alias("max_docs"), lim["max_articles"].cast("long").alias("max_articles"))


CHOSEN = """WITH h AS (SELECT l_orderkey AS q, l_linenumber AS rank, l_quantity AS score, l_partkey % 30 AS a FROM lineitem WHERE l_partkey % 30 % 5 < 4),
e AS (SELECT q, 'L' || a % 7 || '|T L' || a % 7 AS d, 'L' || a % 7 || '|T L' || a % 7 || '|Điều ' || a AS x, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank, 'L' || a % 7 || '|T L' || a % 7 || '|Điều ' || a) AS pos FROM h),
l AS (SELECT q, CASE q % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS nd, CASE q % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS na FROM (SELECT DISTINCT l_orderkey AS q FROM lineitem)),
ax AS (SELECT q, x, min(d) AS d, row_number() OVER (PARTITION BY q ORDER BY min(pos)) AS n FROM e GROUP BY q, x), ac AS (SELECT ax.* FROM ax JOIN l USING (q) WHERE n <= na),
dx AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY min(o)) AS n FROM (SELECT q, d, n AS o FROM ac UNION ALL SELECT q, d, 1000 + pos FROM e) GROUP BY q, d), dc AS (SELECT dx.* FROM dx JOIN l USING (q) WHERE n <= nd)
SELECT l.q AS query_id, coalesce((SELECT string_agg(d, '#' ORDER BY n) FROM dc WHERE dc.q = l.q), '') AS docs, coalesce((SELECT string_agg(x, '#' ORDER BY n) FROM ac WHERE ac.q = l.q), '') AS articles FROM l"""


@query(CHOSEN)
def citation_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey") % 30
    hits = items.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), T.safe_float(F.lit("none"), F.col("l_quantity")).alias("score"), text_of("a", key).alias("article_id"))
    code = text_of("L", F.col("k") % 7)
    cited = spark.range(30).withColumnRenamed("id", "k").where("k % 5 < 4").select(text_of("a", F.col("k")).alias("article_id"), code.alias("code"), F.concat(F.lit("T "), code).alias("title"), text_of("Điều ", F.col("k")).alias("article"))
    asked = items.select(F.col("l_orderkey").alias("query_id")).distinct().withColumn("question", pick(["Khoản 2 Điều 47 quy định gì?", "Vốn là gì?", "Thủ tục ra sao và phải nộp gì?"], F.col("query_id")))
    out = citations.select(asked, citations.with_citations(hits, cited))
    return out.select("query_id", F.array_join("relevant_docs", "#").alias("docs"), F.array_join("relevant_articles", "#").alias("articles"))


@query("""WITH e AS (SELECT n_nationkey AS k, unnest(range(1, n_nationkey % 6 + 2)) AS j FROM nation), x AS (SELECT k, j, 'L' || (k + j) % 3 || '|T L' || (k + j) % 3 AS d FROM e WHERE j <> 2),
l AS (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS nd, CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS na FROM nation),
a AS (SELECT k, d, d || '|Điều ' || j AS x, row_number() OVER (PARTITION BY k ORDER BY j) AS n FROM x), ac AS (SELECT a.* FROM a JOIN l USING (k) WHERE n <= na),
dx AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY min(n)) AS n FROM (SELECT k, d, n FROM ac UNION ALL SELECT k, 'L9|T L9', 1000 FROM l) GROUP BY k, d), dc AS (SELECT dx.* FROM dx JOIN l USING (k) WHERE n <= nd)
SELECT k::BIGINT AS id, (SELECT string_agg(d, '#' ORDER BY n) FROM dc WHERE dc.k = l.k) AS docs, (SELECT string_agg(x, '#' ORDER BY n) FROM ac WHERE ac.k = l.k) AS articles FROM l""")
def citation_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = lambda j: F.concat(F.lit("L"), ((F.col("n_nationkey") + j) % 3).cast("string"), F.lit("|T L"), ((F.col("n_nationkey") + j) % 3).cast("string"))
    entries = F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 6 + 1), lambda j: F.when(j == 2, "bad").otherwise(F.concat(doc(j), F.lit(" | Điều "), j.cast("string"))))
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), pick(["Điều 5 nói gì", "vốn là gì", "Thủ tục ra sao và phải nộp gì?"], F.col("n_nationkey")).alias("question"), F.lit("a").alias("answer"), F.array(F.lit("L9|T L9")).alias("relevant_docs"), entries.alias("relevant_articles")
    )
    out = citations.postprocess(rows)
    return out.select("id", F.array_join("relevant_docs", "#").alias("docs"), F.array_join("relevant_articles", "#").alias("articles"))


@query("""SELECT o_orderkey AS id, ['question differs', 'no answer', 'relevant_docs: not 2 fields', 'relevant_articles: not an article', 'id is not asked', 'relevant_docs: repeated entries', 'relevant_docs: title without its code', 'relevant_articles: not 3 fields'][(o_orderkey % 9)::INT] AS problem
FROM orders WHERE o_orderkey % 9 > 0""")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, code = F.col("o_orderkey") % 9, text_of(F.col("o_custkey"), "/2020/L")
    doc = F.concat(code, F.lit("|Luật "), code)
    docs = F.when(i == 3, F.array(code)).when(i == 6, F.array(doc, doc)).when(i == 7, F.array(F.concat(code, F.lit("|Luật")))).otherwise(F.array(doc))
    articles = F.when(i == 4, F.array(F.concat(doc, F.lit("|4")))).when(i == 8, F.array(doc)).otherwise(F.array(F.concat(doc, F.lit("|Điều 4"))))
    orders = table(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"])
    rows = orders.select(F.col("o_orderkey").alias("id"), F.when(i == 1, "other").otherwise("q").alias("question"), F.when(i == 2, " ").otherwise("a").alias("answer"), docs.alias("relevant_docs"), articles.alias("relevant_articles"))
    return submission.record_problems(rows, orders.where(i != 5).select(F.col("o_orderkey").alias("id"), F.lit("q").alias("question")))


