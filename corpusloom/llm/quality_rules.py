"""Quality rules with thresholds that follow the data, in DataFrame operations only.

Every document is measured in one pass without a shuffle. A ratio of counts is taken as far as its count exceeds
chance (the count less ``CHANCE`` times its root): one repeated line of five says little, fifty of 250 do. Each ratio is put
on a logarithmic scale of fixed bins (relative width ``GROWTH``): counts per bin are a quantile sketch that merges by
addition, in any order, with a relative error of a bin. The sketches are kept per language and source and merged
upwards, to the language and to all documents; a group of fewer than ``LEAST`` documents uses the next larger one.

Quantiles of the group are the only source of its fences (``RULES``): a ratio is rejected beyond an outer quantile plus so many times
that quantile's distance from the median. No cutoff is fixed: where three quarters of a source have no symbols any of them stands
out, and where most documents are full of them none does. The documents are joined with the fences (a table of one
row a group) and filtered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .oracles import quality

#: Java's class of the contracts' white space.
SPACE = " \t\n\x0b\f\r"
SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
LEAST = 50
#: A bin's upper end over its lower end.
GROWTH = 1.01
#: Values below this count as this (bin 0).
FLOOR = 1e-3
#: Roots of a count that chance may bring.
CHANCE = 3.0
#: The least distance between quantiles, as a share of the median: a bin, which is what the sketch can tell apart.
APART = GROWTH - 1
#: (ratio, side, outer quantile, how many times its distance from the median the fence lies beyond it)
RULES = [
    ("symbols_per_word", "high", 0.75, 8.0),
    ("dup_line_share", "high", 0.75, 8.0),
    ("repeat_share", "high", 0.99, 1.0),
    ("capital_share", "high", 0.75, 12.0),
    ("chars_per_word", "high", 0.75, 8.0),
    ("chars_per_word", "low", 0.25, 8.0),
]


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash and the counts of each document (a null text is empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.regexp_replace(text, f"^{SPLIT}|{SPLIT}$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    base = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    windows = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(
        let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    )
    counted = base.select(
        "doc_id", "lang", "source", "text_hash",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "\\p{Lu}", ""))).cast("long").alias("n_capitals"),
        windows.alias("windows"),
    )
    placed = F.sort_array(F.transform(F.col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = let(placed, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(covered)
    return counted.withColumn("n_repeat_words", repeats.cast("long")).drop("windows")


def ratios(counted: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    beyond = lambda c: F.greatest(F.col(c) - CHANCE * F.sqrt(F.col(c).cast("double")), F.lit(0.0))
    return counted.withColumns({
        "symbols_per_word": beyond("n_symbols") / n,
        "dup_line_share": beyond("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": beyond("n_repeat_words") / n,
        "capital_share": beyond("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "chars_per_word": F.col("word_chars") / n,
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def bin_of(value: Column) -> Column:
    return F.ceil(F.log(F.greatest(value, F.lit(FLOOR)) / FLOOR) / F.log(F.lit(GROWTH))).cast("int")


def value_of(at: Column) -> Column:
    return F.lit(FLOOR) * F.pow(F.lit(GROWTH), at)


def fences(measures: DataFrame) -> DataFrame:
    """One row a (lang, source) with the fence of each rule. The sketches hold at most about a thousand bins a ratio
    and group, whatever the number of documents; a hot source is summed before the shuffle."""
    names = sorted({r[0] for r in RULES})
    entries = F.array(*[F.struct(F.lit(n).alias("ratio"), bin_of(F.col(n)).alias("bin")) for n in names])
    long = measures.where(~F.col("base_failed")).select("lang", "source", F.explode(entries).alias("x"))
    sketch = cut(long.groupBy("lang", "source", "x.ratio", "x.bin").agg(F.count("*").alias("n")), "sketch")

    def quantiles(level: str, keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "ratio")
        run = merged.select(*keys, "ratio", "bin", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("total"))
        at = lambda name, q: F.min(F.when((F.col("ratio") == name) & (F.col("upto") >= q * F.col("total")), F.col("bin")))
        found = [F.struct(at(name, 0.5).alias("middle"), at(name, q).alias("outer")).alias(f"{side}_{name}") for name, side, q, _ in RULES]
        return run.groupBy(*keys).agg(F.struct(F.max("total").alias("total"), *found).alias(level))

    out = measures.select("lang", "source").distinct()
    for level, keys in (("of_source", ["lang", "source"]), ("of_lang", ["lang"]), ("of_all", [])):
        right = quantiles(level, keys).select(*[F.col(k).alias(f"right_{k}") for k in keys], level)
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys], F.lit(True))
        out = out.join(right, on, "left").drop(*[f"right_{k}" for k in keys])
    enough = lambda level: F.when(F.col(level)["total"] >= LEAST, F.col(level))
    out = out.select("lang", "source", F.coalesce(enough("of_source"), enough("of_lang"), enough("of_all"), F.col("of_all")).alias("q"))
    limits = []
    for name, side, _, times in RULES:
        q = F.col("q")[f"{side}_{name}"]
        middle, outer = value_of(q["middle"]), value_of(q["outer"] if side == "high" else q["outer"] - 1)
        reach = times * F.greatest(F.abs(outer - middle), APART * middle)
        limits.append((outer + reach if side == "high" else outer - reach).alias(f"{side}_{name}"))
    return out.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), *limits)


def verdicts(docs: DataFrame) -> DataFrame:
    """What quality_rules gives, with lang, source and text_hash, which tell rows with one id apart."""
    measures = cut(ratios(measured(docs)), "measures")
    limits = fences(measures)
    joined = measures.join(limits, F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left")
    beyond = [(F.col(n) > F.col(f"high_{n}")) if side == "high" else (F.col(n) < F.col(f"low_{n}")) for n, side, _, _ in RULES]
    broken = reduce(lambda a, b: a | b, [F.coalesce(b, F.lit(False)) for b in beyond])
    return joined.select("doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~broken).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every document.

    Null and empty texts have no words and fail the base rule. Null languages and sources are groups of their
    own. Repeated ids are judged row by row; texts of any length are measured whole; other columns aren't read. In
    an empty table nothing is judged. A document is rejected where the base rule fails or a ratio is beyond the
    fence of its language and source.
    """
    return verdicts(docs).drop("lang", "source", "text_hash")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, each by its own verdict, with all their columns (but one named text_hash)."""
    docs = docs.drop("text_hash")
    keys = ("doc_id", "lang", "source", "text_hash")
    good = verdicts(docs).where("kept").select(*[F.col(k).alias(f"good_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"good_{k}")) for k in keys])
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    return rows.join(good, same, "left_semi").select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": quality(RULES, GROWTH, FLOOR, CHANCE, LEAST, APART, MIN_WORDS)}
