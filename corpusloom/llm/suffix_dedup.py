"""Suffix-array deduplication: bytes inside a repeated string of 400 bytes go, in all its copies.

:mod:`repeats` brings the strings that may share a window together. Here a shard of them is indexed byte by byte:

* a suffix array gives the Burrows-Wheeler transform;
* starting from the intervals of single bytes, intervals are extended backward by every preceding byte at once, breadth
  first (:meth:`fm_index.FMIndex.common_prefixes`). Where a new interval ends, suffixes part; so common prefixes are
  found by increasing value, and the expansion stops at the minimum length;
* the rows between places with a smaller value share that many bytes. Where such an interval stands for two or more
  occurrences (collapsed copies count as often as they occur), its windows are removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fm_index import FMIndex, intervals, joined
from .oracles import repeated_bytes
from .repeats import Kind, Shard, without_repeats

LENGTH, GRAM = 400, 200


def repeated_windows(length: int):
    """For each window of a shard whether it occurs again (for both answers: all copies go)."""

    def index(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        text, base = joined([np.frombuffer(t, np.uint8).astype(np.int64) + 1 for t in shard.texts])
        found = FMIndex(text, length, shard.weight(base, len(text)))
        first, of = intervals(found.common_prefixes(length), length)
        copies = found.copies(first, np.append(first[1:], found.n))
        at = np.empty(found.n, np.int64)
        at[found.sa] = copies[of]
        again = at[shard.windows(base)] > 1
        return again, again

    return index


def remove_repeated_bytes(docs: DataFrame, with_text: bool = True, carried: tuple[str, ...] = (), length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The carried columns, doc_id, total, removed, spans, kept (bytes), sha, anchors: see :func:`repeats.without_repeats` for odd rows.

    ``length`` is the shortest repeated string that goes; ``gram`` (shorter) only deals text to shards.
    """
    return without_repeats(docs, Kind("byte", length, gram, keep_first=False), repeated_windows(length), with_text, carried)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_shared_anchors: places with a string of 200 bytes or more that is somewhere else, too, whether or not 400 bytes repeat."""
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", F.col("total").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.col("anchors").alias("n_shared_anchors"))


def suffix_array_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result without the hint, which hangs on hashes and so has no SQL."""
    return op8_suffix_array_dedup(spark, sf_dir).drop("n_shared_anchors")


QUERIES = {"op8_suffix_array_dedup": op8_suffix_array_dedup, "suffix_array_removal": suffix_array_removal}
ORACLE_SQL = {"suffix_array_removal": repeated_bytes(LENGTH)}
