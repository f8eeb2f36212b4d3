"""Reading what the pipelines take, with explicit schemas; a broken row is an error where the contract says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

RECORD = "id bigint, question string, answer string, relevant_docs array<string>, relevant_articles array<string>"
ARTICLE = ", ".join(f"{c} string" for c in ("subject_title", "topic_title", "chapter_title", "article_title", "source_note_text", "source_url", "source_links", "subject_number", "topic_number", "article_number", "text"))


def fail_unless(ok: Column, value: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def articles(spark: SparkSession, path: str, fmt: str = "parquet", limit: int | None = None) -> DataFrame:
    """A table of raw articles; JSON gets a schema, Parquet has one."""
    rows = spark.read.schema(ARTICLE).json(path) if fmt == "json" else spark.read.format(fmt).load(path)
    return rows if limit is None else rows.limit(limit)


def article_citations(spark: SparkSession, path: str) -> DataFrame:
    """The two columns that citations need."""
    rows = spark.read.schema("article_id string, source_note_text string").option("mode", "FAILFAST").json(path)
    return rows.where(F.coalesce("article_id", F.lit("")) != "")


def chunks(spark: SparkSession, path: str, schema: str = "chunk_id string, text string, article_id string, article_title string", limit: int | None = None, empty: bool = False) -> DataFrame:
    """Passages from JSON lines: bad JSON and missing ids are errors, blank texts are left out before the limit. Where ``empty``,
    only texts of white space are; an empty or null text is a passage."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = rows.withColumn("chunk_id", fail_unless(T.strip(F.col("chunk_id")) != "", F.col("chunk_id"), "a passage has no chunk_id"))
    inked = F.coalesce(T.strip(F.col("text")), F.lit("")) != ""
    rows = rows.where(inked | (F.coalesce("text", F.lit("")) == "") if empty else inked)
    return rows if limit is None else rows.limit(limit)


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, query, relevance_field, relevant: each case has chunk ids or article ids, not both. Ids default to the
    line's number in its file."""
    schema = "id string, query string, relevant_chunk_ids array<string>, relevant_article_ids array<string>"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    rows = lines.where(T.strip(F.col("line")) != "").select("n", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("j")).select("n", "j.*")
    none = T.empty_strings()
    a, b = (T.clean_ids(F.coalesce(c, none)) for c in ("relevant_chunk_ids", "relevant_article_ids"))
    one = (F.size(a) > 0) != (F.size(b) > 0)
    return rows.select(
        F.coalesce("id", F.concat(F.lit("case-"), (F.col("n") + 1).cast("string"))).alias("case_id"), "query", F.when(F.size(a) > 0, "chunk_id").otherwise("article_id").alias("relevance_field"),
        fail_unless(one, F.when(F.size(a) > 0, a).otherwise(b), "a case needs chunk ids or article ids").alias("relevant"),
    )


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of a file that holds one JSON array, with their order in it; broken JSON is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.monotonically_increasing_id().alias("pos"), "*")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """id, question, pos. No questions, repeated ids, ids that aren't integers and blank questions are errors."""
    rows = json_array(spark, path, "id string, question string")
    number = F.when(F.col("id").rlike(r"^-?\d+$"), F.col("id").try_cast("bigint"))
    rows = rows.select(fail_unless(number.isNotNull(), number, "a question's id must be an integer").alias("id"), fail_unless(T.strip(F.col("question")) != "", F.col("question"), "a question is blank").alias("question"), "pos")
    if rows.isEmpty():
        raise ValueError("there are no questions")
    twice = rows.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"question {twice[0]['id']} occurs twice")
    return rows


def records(spark: SparkSession, path: str) -> DataFrame:
    """Answer records of a JSON array; all fields are needed."""
    rows = json_array(spark, path, RECORD)
    for c in ("id", "question", "answer", "relevant_docs", "relevant_articles"):
        rows = rows.withColumn(c, fail_unless(F.col(c).isNotNull(), F.col(c), f"a record has no {c}"))
    return rows


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Answer records for scoring: questions and answers may be missing, lists default to empty."""
    rows = json_array(spark, path, RECORD)
    return rows.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer")], *[F.coalesce(c, T.empty_strings()).alias(c) for c in ("relevant_docs", "relevant_articles")])


def phrases(spark: SparkSession, path: str, defaults: tuple[str, ...] = T.PHRASES) -> tuple[str, ...]:
    """The default terms and those of a file (one a line, # starts a comment), in order, without repeats."""
    lines = [r["value"].strip() for r in spark.read.text(path).collect()]  # a settings file
    return tuple(dict.fromkeys([*defaults, *(x for x in lines if x and not x.startswith("#"))]))


def shards(spark: SparkSession, path: str, start: int | None = None, pattern: str = "*_*.parquet") -> DataFrame:
    """Rows of numbered Parquet files with shard (its number); a gap in the numbers or a missing column is an error."""
    rows = spark.read.option("pathGlobFilter", pattern).parquet(path)
    lacking = {"point_id", "vector"} - set(rows.columns)
    if lacking:
        raise ValueError(f"shards lack {sorted(lacking)}")
    rows = rows.withColumn("shard", T.shard_number(F.col("_metadata.file_name")))
    gaps = shard_gaps(rows)
    if gaps:
        raise ValueError(f"shards are missing: {gaps}")
    return rows if start is None else rows.where(F.col("shard") >= start)


def shard_manifest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(F.count("*").alias("n_rows")).orderBy("shard")


def shard_gaps(rows: DataFrame, column: str = "shard") -> list[int]:
    have = rows.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.array_sort(F.collect_set(column)).alias("s"))
    got = have.select(F.array_except(F.sequence("a", "b"), "s").alias("gaps")).first()["gaps"]
    return got or []


def case_hits(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, retrieved (ids of the case's kind in rank order), relevant. hits: case_id, rank, chunk_id, article_id."""
    from corpusloom.operators.metrics import relevance_ids

    rows = cases.join(hits, "case_id", "left").withColumn("key", relevance_ids(F.col("relevance_field"), F.col("chunk_id"), F.col("article_id")))
    item = F.when(F.col("rank").isNotNull(), F.struct("rank", "key"))
    return rows.groupBy("case_id").agg(F.first("relevant").alias("relevant"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["key"]).alias("retrieved"))


