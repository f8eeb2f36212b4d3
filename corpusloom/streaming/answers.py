"""Answering questions in micro-batches that can be stopped and taken up again.

Questions come as files; a checkpointed file source with availableNow gives each file once. A batch's answers are
appended under the batch's number, so a batch that is run again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import submission


def answer_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], files_per_batch: int = 1) -> int:
    """Run until the present files are done; the number of batches. answer: questions -> records."""
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def saved(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What has been answered so far (an empty table before the first batch)."""
    try:
        return spark.read.parquet(out).drop("batch")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return spark.createDataFrame([], schema)
        raise


def generate(spark: SparkSession, questions: DataFrame, out: str, schema: str, answer: Callable[[DataFrame], DataFrame], checkpoint_every: int = 100, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """Answer what isn't saved yet in slices of about ``checkpoint_every`` questions, each saved when it is done, then
    check and return all records in the questions' order. report: how many of how many are done, after each slice."""
    before = saved(spark, out, schema)
    submission.validate(before, questions, partial=True) if not before.isEmpty() else None
    todo = submission.unanswered(questions, before)
    n = todo.count()
    slices = max(1, -(-n // checkpoint_every))
    start = 0 if before.isEmpty() else spark.read.parquet(out).agg(F.max("batch")).first()[0] + 1
    for k in range(slices if n else 0):
        part = todo.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k)
        answer(part).write.mode("overwrite").parquet(f"{out}/batch={start + k}")
        if report:
            report(saved(spark, out, schema).count(), questions.count())
    records = saved(spark, out, schema)
    submission.validate(records, questions)
    return records.join(questions.select("id", "pos"), "id").orderBy("pos").drop("pos")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events by window and type with a watermark (ts, event_type, value); works on streams and tables."""
    window = F.window("ts", width, slide or width)
    counted = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
