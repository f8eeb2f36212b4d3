"""Citations: found in source notes, completed over the corpus, chosen for an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import CitationConfig
from corpusloom.functions import text as T

# Document types, the patterns of citations and of questions.
DOCUMENT_TYPES = ("Nghị quyết liên tịch", "Thông tư liên tịch", "Văn bản hợp nhất", "Bộ luật", "Pháp lệnh", "Nghị định", "Thông tư", "Quyết định", "Chỉ thị", "Nghị quyết", "Luật")
DOCUMENT = (
    "(?iuUs)(" + "|".join(DOCUMENT_TYPES) + r")\s+(?:số\s+)?(\d{1,5}(?:/\d{4})?/[\wÀ-ỹĐđ]+(?:-[\wÀ-ỹĐđ]+)*)(.*?)"
    r"(?=\s+ngày\s+\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\s+của\s+|,|\)|$)"
)
ARTICLE = r"(?iuU)\bĐiều\s+(\d+[A-Za-zÀ-ỹĐđ]*(?:\.\d+)*)\b"
SUMMARY_ENDS = (" có hiệu lực", " được sửa đổi", " đã được sửa đổi")
EXACT = r"(?iuU)\b(?:điều|khoản|điểm)\s+\d|\b\d{1,5}/\d{4}/[\wÀ-ỹĐđ-]+"
MULTI = (
    r"(?iuU)\b(?:như thế nào|ra sao)\s+và\s+",
    r"(?iuU)\bvà\s+(?:phải|cần|bị|được|xử lý|khắc phục|áp dụng|nộp|thực hiện)\b",
    r"(?iuU)\bvề\s+[^?]{3,80}\s+và\s+[^?]{3,80}\?",
    r"(?iuU)\b(?:thuế|đất đai|kế toán|bảo hiểm|xử phạt|khắc phục)\b[^?]*\bvà\b",
)
FIELDS = ("relevant_docs", "relevant_articles")
PROTECTED = ("doanh nghiệp nhỏ và vừa", "nhỏ và vừa", "vừa và nhỏ")


def document_type(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in DOCUMENT_TYPES:
        out = F.when(F.lower(c) == name.lower(), name).otherwise(out)
    return out


def summary(c: Column) -> Column:
    c = F.btrim(T.squeeze(c), F.lit(" ,;:-()"))
    for mark in SUMMARY_ENDS:
        at = F.instr(F.lower(c), mark)
        c = F.when(at > 0, F.rtrim(F.regexp_replace(F.substr(c, F.lit(1), at - 1), "[ ,;:-]+$", ""))).otherwise(c)
    return c


def citation_seeds(articles: DataFrame) -> DataFrame:
    """article_id, doc_type, code, summary, article of the notes that name a document and an article."""
    note = F.col("source_note_text")
    rows = articles.where(F.coalesce(F.col("article_id"), F.lit("")) != "").where(note.rlike(DOCUMENT) & note.rlike(ARTICLE))
    return rows.select(
        "article_id", document_type(F.regexp_extract(note, DOCUMENT, 1)).alias("doc_type"), T.squeeze(F.regexp_extract(note, DOCUMENT, 2)).alias("code"),
        summary(F.regexp_extract(note, DOCUMENT, 3)).alias("summary"), F.concat(F.lit("Điều "), F.regexp_extract(note, ARTICLE, 1)).alias("article"),
    )


def resolve(articles: DataFrame) -> DataFrame:
    """article_id, code, title, article; a note without a summary takes the document's longest one anywhere."""
    seeds = citation_seeds(articles)
    best = seeds.where("summary <> ''").groupBy("doc_type", "code").agg(F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("best"))
    named = F.coalesce(F.nullif("summary", F.lit("")), F.col("best"))
    return seeds.join(best, ["doc_type", "code"], "left").select("article_id", "code", F.concat_ws(" ", "doc_type", F.nullif("code", F.lit("")), F.nullif(named, F.lit(""))).alias("title"), "article")


def with_citations(hits: DataFrame, citations: DataFrame) -> DataFrame:
    """Hits with their citation, null where the article has none."""
    return hits.join(citations, "article_id", "left")


def doc_entry(code: Column, title: Column) -> Column:
    return F.concat_ws("|", code, title)


def article_entry(code: Column, title: Column, article: Column) -> Column:
    return F.concat_ws("|", code, title, article)


def parsed_entry(entry: Column, parts: int = 3) -> Column:
    """The trimmed fields of an entry, null unless there are so many and none is empty."""
    fields = F.transform(F.split(entry, r"\|", -1), T.strip)
    return F.when((F.size(fields) == parts) & F.forall(fields, lambda x: x != ""), fields)


def profile(question: Column) -> Column:
    folded = F.lower(question)
    plain = folded
    for phrase in PROTECTED:
        plain = F.replace(plain, F.lit(phrase), F.lit(phrase.replace(" và ", " ")))
    many = F.lit(False)
    for pattern in MULTI:
        many = many | plain.rlike(pattern)
    return F.when(folded.rlike(EXACT), "exact_lookup").when(many, "multi_issue").otherwise("simple")


def limits(question: Column, config: CitationConfig = CitationConfig()) -> Column:
    """struct<max_docs, max_articles> of a question."""
    kind = profile(question)
    pair = lambda i: F.when(kind == "exact_lookup", config.exact_lookup[i]).when(kind == "multi_issue", config.multi_issue[i]).otherwise(config.simple[i])
    return F.struct(pair(0).alias("max_docs"), pair(1).alias("max_articles"))


def select(questions: DataFrame, cited: DataFrame, config: CitationConfig = CitationConfig()) -> DataFrame:
    """query_id, relevant_docs, relevant_articles. questions: query_id, question; cited: query_id, rank, score, code, title,
    article (nulls for hits without a citation)."""
    rows = cited.where("code IS NOT NULL")
    if config.min_score is not None:
        rows = rows.where(F.col("score") >= config.min_score)
    if config.score_margin is not None:
        top = F.max("score").over(Window.partitionBy("query_id"))
        rows = rows.withColumn("top", top).where(F.col("top").isNull() | (F.col("score") >= F.col("top") - config.score_margin)).drop("top")
    item = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("o"), "rank", article_entry(F.col("code"), F.col("title"), F.col("article")).alias("a"), doc_entry(F.col("code"), F.col("title")).alias("d"))
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<string>")
    base = questions.select("query_id", limits(F.col("question"), config).alias("lim")).join(ordered, "query_id", "left")
    articles = F.coalesce(T.first_unique(F.transform("items", lambda x: x["a"]), F.col("lim.max_articles")), empty)
    base = base.withColumn("relevant_articles", articles)
    of_articles = F.transform("relevant_articles", lambda a: F.substring_index(a, "|", 2))
    docs = T.first_unique(F.concat(of_articles, F.coalesce(F.transform("items", lambda x: x["d"]), empty)), F.col("lim.max_docs"))
    return base.select("query_id", docs.alias("relevant_docs"), "relevant_articles")


def postprocess(records: DataFrame, config: CitationConfig = CitationConfig()) -> DataFrame:
    """Quotas applied to finished records: unparseable articles go, the order stays, everything else is untouched."""
    lim = limits(F.col("question"), config)
    good = F.filter("relevant_articles", lambda a: parsed_entry(a).isNotNull())
    kept = T.first_unique(F.transform(good, lambda a: F.array_join(parsed_entry(a), "|")), lim["max_articles"])
    rows = records.withColumn("kept", kept)
    docs = F.concat(F.transform("kept", lambda a: F.substring_index(a, "|", 2)), F.col("relevant_docs"))
    return rows.withColumn("relevant_docs", T.first_unique(docs, lim["max_docs"])).withColumn("relevant_articles", F.col("kept")).drop("kept")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """field, before, after: how many citations records hold in all."""
    count = lambda df, name: df.agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(c) for c in FIELDS]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias(name)) for c in FIELDS])).alias("x")).select("x.*")
    return count(before, "before").join(count(after, "after"), "field")
