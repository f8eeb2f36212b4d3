"""Answer records: checks, context for an answer, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import ContextConfig
from corpusloom.functions import text as T

from .citations import parsed_entry

# Fixed value: what an article's field looks like.
ARTICLE_FIELD = r"(?iuU)^Điều\s+\S+"


def entries_problem(entries: Column, parts: int, name: str) -> Column:
    """The first rule that a list of entries breaks, or null."""
    parsed = F.transform(entries, lambda e: parsed_entry(e, parts))
    return (
        F.when(entries.isNull(), f"{name}: not a list").when(F.size(F.array_distinct(entries)) != F.size(entries), f"{name}: repeated entries")
        .when(F.exists(parsed, lambda p: p.isNull()), f"{name}: not {parts} fields").when(F.exists(parsed, lambda p: ~F.contains(F.get(p, F.lit(1)), F.get(p, F.lit(0)))), f"{name}: title without its code")
        .when(F.lit(parts == 3) & F.exists(parsed, lambda p: ~F.get(p, F.lit(2)).rlike(ARTICLE_FIELD)), f"{name}: not an article")
    )


def record_problems(records: DataFrame, questions: DataFrame) -> DataFrame:
    """id, problem of each record that breaks a rule; coverage isn't looked at."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("question"))
    rows = records.withColumn("nth", nth).join(questions.select(F.col("id").alias("qid"), F.col("question").alias("asked")), F.col("id") == F.col("qid"), "left")
    problem = F.coalesce(
        F.when(F.col("id").isNull(), "no id"), F.when(F.col("nth") > 1, "repeated id"), F.when(F.col("qid").isNull(), "id is not asked"), F.when(F.col("question") != F.col("asked"), "question differs"),
        F.when(F.coalesce(T.strip(F.col("answer")), F.lit("")) == "", "no answer"), entries_problem(F.col("relevant_docs"), 2, "relevant_docs"), entries_problem(F.col("relevant_articles"), 3, "relevant_articles"),
    )
    return rows.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def coverage_problems(records: DataFrame, questions: DataFrame) -> DataFrame:
    missing = questions.select("id").join(records.select("id"), "id", "left_anti").withColumn("problem", F.lit("missing"))
    extra = records.select("id").join(questions.select("id"), "id", "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def validate(records: DataFrame, questions: DataFrame, partial: bool = False) -> None:
    """Raise with up to ten findings; a partial set of records needs no coverage."""
    found = record_problems(records, questions)
    if not partial:
        found = found.unionByName(coverage_problems(records, questions))
        if records.isEmpty():
            raise ValueError("there are no records")
    if questions.isEmpty():
        raise ValueError("there are no questions")
    some = found.orderBy("id", "problem").limit(10).collect()
    if some:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in some))


def unanswered(questions: DataFrame, saved: DataFrame) -> DataFrame:
    return questions.join(saved.select("id"), "id", "left_anti")


def resumed(questions: DataFrame, saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved records of asked questions and new ones, in the questions' order (column pos)."""
    rows = saved.join(questions.select("id"), "id", "left_semi").unionByName(new)
    return rows.join(questions.select("id", "pos"), "id").orderBy("pos").drop("pos")


def render_context(items: Column, config: ContextConfig = ContextConfig()) -> Column:
    """Numbered or cited blocks of array<struct<text, heading>> (heading null for none) under the character budget.

    Headings count, but only texts are cut; an item that starts beyond the budget isn't shown."""
    numbered = F.transform(items, lambda x, i: F.struct(F.coalesce(x["heading"], F.concat(F.lit("Căn cứ "), (i + 1).cast("string"))).alias("h"), F.substring(T.strip(x["text"]), 1, config.per_context).alias("t")))

    def add(acc: Column, x: Column) -> Column:
        text = F.substr(x["t"], F.lit(1), F.greatest(F.lit(config.total) - acc["used"], F.lit(0)))
        item = F.concat(F.lit("["), x["h"], F.lit("]\n"), text)
        return F.when(text == "", acc).otherwise(F.struct(F.concat(acc["out"], F.array(item)).alias("out"), (acc["used"] + F.length(item)).alias("used")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))
    return F.aggregate(numbered, start, add, lambda acc: F.array_join(acc["out"], "\n\n"))


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("CÂU HỎI:\n"), question, F.lit("\n\nNGỮ CẢNH PHÁP LÝ:\n"), context, F.lit("\n\nHãy trả lời câu hỏi chỉ dựa trên các căn cứ trên."))


def to_json_record(*cols: str) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
