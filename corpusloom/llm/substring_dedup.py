"""Substring deduplication: words of a 20-word window that also starts earlier go; the first stays.

:mod:`repeats` brings the strings that may share a window together. A shard of them gets a compressed FM-index:
the Burrows-Wheeler transform of its words in a wavelet matrix of packed bits, with a count every 64 bits, and every
eighth place of the text. The shard's documents are streamed through it from right to left, all in step, by
backward search: matching statistics say at each word how much of what follows occurs once more in the shard (up to
the threshold). A word in front that leaves fewer than two occurrences shortens the match to the next interval that is
larger. Intervals whose match reaches 20 words are reported; their places, found by walking to sampled ones, say
which window is the first of its kind.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, word_hashes, words
from .fm_index import FMIndex, joined
from .oracles import repeated_words
from .repeats import Kind, Shard, without_repeats

LENGTH, GRAM = 20, 8
SAMPLED = 8


class Parents:
    """For each row the ends of its interval of suffixes that share d symbols, for all d up to ``most``."""

    def __init__(self, common: np.ndarray, most: int):
        n = len(common)
        at = np.arange(n, dtype=np.int32)
        self.common = np.append(common, 0)
        self.first, self.end = np.zeros((most + 1, n), np.int32), np.full((most + 1, n), n, np.int32)
        for d in range(1, most + 1):
            new = common < d
            self.first[d] = np.maximum.accumulate(np.where(new, at, 0))
            self.end[d, :-1] = np.minimum.accumulate(np.where(new, at, n)[:0:-1])[::-1]

    def widened(self, depth: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[depth, lo].astype(np.int64), self.end[depth, hi - 1].astype(np.int64)


def matching_statistics(index: FMIndex, texts: np.ndarray, base: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of strings streamed through the index: the length of the longest start of what follows that stands for two
    or more occurrences, at most ``most``, and its interval of rows."""
    parents = Parents(index.common_prefixes(most), most)
    length, low, high = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    lo, hi, m = np.zeros(len(base), np.int64), np.full(len(base), index.n, np.int64), np.zeros(len(base), np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    for j in range(int(sizes.max(initial=0)) - 1, -1, -1):
        on = by_size[: np.searchsorted(-sizes[by_size], -j, "left")]  # strings of more than j symbols
        todo = on
        while len(todo):
            a, b = index.step(texts[base[todo] + j], lo[todo], hi[todo])
            enough = index.copies(a, b) > 1
            go = todo[enough]
            lo[go], hi[go], m[go] = a[enough], b[enough], m[go] + 1
            over = go[m[go] > most]
            m[over] = most
            lo[over], hi[over] = parents.widened(m[over], lo[over], hi[over])
            todo = todo[~enough]
            todo = todo[m[todo] > 0]  # others: not even the word itself occurs again
            m[todo] = np.minimum(m[todo] - 1, np.maximum(parents.common[lo[todo]], parents.common[hi[todo]]))
            lo[todo], hi[todo] = parents.widened(m[todo], lo[todo], hi[todo])
        length[base[on] + j], low[base[on] + j], high[base[on] + j] = m[on], lo[on], hi[on]
    return length, low, high


def repeated_windows(shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a shard whether it occurs again, and whether it occurs at an earlier place."""
    data = np.frombuffer(b" ".join(shard.texts) + b" ", np.uint8)
    offsets = np.append(0, np.cumsum([len(t) + 1 for t in shard.texts]))
    starts, ends, of = words(data, offsets)
    ids = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1] + 1
    sizes = np.diff(of)
    text, base = joined([ids[a:b] for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)])
    index = FMIndex(text, len(text), shard.weight(base, len(text)), sampled=SAMPLED)
    length, low, high = matching_statistics(index, text, base, sizes, LENGTH)
    windows = shard.windows(base)
    again = length[windows] >= LENGTH
    later = np.zeros(len(windows), bool)
    hit = np.flatnonzero(again)
    if len(hit):
        reported, which = np.unique(low[windows[hit]], return_inverse=True)
        ends = np.empty(len(reported), np.int64)
        ends[which] = high[windows[hit]]
        counts = ends - reported
        order = shard.order()
        rank = np.full(len(text), len(windows))
        rank[windows] = order
        first = np.minimum.reduceat(rank[index.places(spread(reported, counts))], np.cumsum(counts) - counts)
        later[hit] = first[which] < order[hit]
    return again, later


def remove_repeated_words(docs: DataFrame, with_text: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, doc_id, total, removed, spans, kept (bytes), sha, anchors: see :func:`repeats.without_repeats` for odd rows."""
    return without_repeats(docs, Kind("word", LENGTH, GRAM, keep_first=True), repeated_windows, with_text, carried)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", F.col("total").alias("n_words"), F.col("removed").alias("n_removed"), F.col("sha").alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE_SQL = {"op6_substring_dedup": repeated_words(LENGTH)}
