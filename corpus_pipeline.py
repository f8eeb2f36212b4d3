"""A training corpus from raw documents: quality rules, near-duplicate removal, removal of repeated passages,
surrogates for personal data, packing into sequences.

Each stage takes the documents that the one before has kept, written as Parquet and read again. All but the last
return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, table, without
from corpusloom.llm.ngram_join import jaccard_components
from corpusloom.llm.packing import TOKENIZER, best_fit_pack
from corpusloom.llm.pii import key_of, replace_pii
from corpusloom.llm.quality_rules import kept_documents
from corpusloom.llm.suffix_dedup import remove_repeated_bytes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of the shortest passage that goes when it repeats; passages of more than 50 words are longer than this.
PASSAGE = 200

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them. Every row goes by its own verdict, whatever
    its id; null languages and sources are groups of their own."""
    return kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (five words, 0.8).

    Rows without an id or without words stay; rows that share an id stay or go together."""
    copies = jaccard_components(docs, size=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct()
    return without(docs, "doc_id", cut(copies, "copies")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE`` bytes that occur twice or more go from the texts; a character cut in part goes whole.

    Every row stays. Rows without an id are kept as they are; a null text becomes empty; rows that share an id are copies."""
    out = remove_repeated_bytes(docs, carried=("lang", "source"), length=PASSAGE, gram=PASSAGE * 5 // 8)
    raw = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.translate(F.make_valid_utf8(raw), "\ufffd", ""))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced; every row stays, and texts without any are unchanged (null ones null)."""
    return replace_pii(docs.select(*COLUMNS), key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' pieces and their places in sequences; a null or empty text is one piece with the end id alone, and rows with
    a null or shared id are packed each for itself."""
    return best_fit_pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii_surrogates", surrogates),
    ("best_fit_packing", packing),
]

#: SQL can't express the stages; the tests hold every stage, on what the one before has left, against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
