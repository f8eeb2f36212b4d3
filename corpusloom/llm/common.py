"""Shared pieces of the training-data operators.

Nothing here knows about a particular operator: reading tables, cutting lineage in the folder that all
executors share, walking Arrow text columns in bounded pieces, and vectorised hashing of words and byte
windows with prefix sums.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.scratch import cut, discard  # noqa: F401 (the operators take them from here)

#: Bytes of text that one vectorised step looks at; a longer single document is a step of its own.
STEP_BYTES = 2 << 20

#: The word pattern of the contracts: everything between these ASCII white-space bytes.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

#: A-Z to a-z on bytes, nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table of a few numbers each (at most about 12 MB) that may be broadcast.
BROADCAST_ROWS = 250_000


def small_side(df: DataFrame, label: str) -> DataFrame:
    """df as a table, marked for broadcast only if it has been counted to be small; else joins shuffle it."""
    df = cut(df, label)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Bits of the table of :func:`sieve`: 2^18 numbers at most.
SLOTS = 1 << 24


def sieve(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with a column ``maybe``, false only where ``key`` is none of ids' single column. Those ids are broadcast as bits of
    their hashes, a bounded table however many they are, so rows need no shuffle to be told apart."""
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(SLOTS).cast("long"))
    bit = "cast(slot & 63 as int)"
    words = ids.select(slot(ids.columns[0]).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"))
    told = rows.withColumn("slot", slot(key)).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(words), "word", "left")
    return told.withColumn("maybe", F.expr(f"coalesce(shiftright(bits, {bit}) & 1L, 0L) = 1")).drop("slot", "word", "bits")


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose ``key`` is none of the table ids' (of one column of that name); null keys stay. Many ids are joined only with
    the rows that may have them, as a join of all rows would shuffle their texts."""
    if ids.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), key, "left_anti")
    told = sieve(rows, key, ids)
    return told.where("NOT maybe").drop("maybe").unionByName(told.where("maybe").drop("maybe").join(ids, key, "left_anti"))


def most_frequent(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(at most ``limit`` rows with the largest n, all others): cut at a level of log2(n) from the levels' sizes (a few
    thousand numbers), so no task sorts or gathers more than its share."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 64)
    least, total = 0, 0
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect(), key=lambda r: -r["level"]):
        total += row["size"]
        if total > limit:
            least = row["level"] + 1
            break
    return counts.where(level >= least), counts.where(level < least)


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and its offsets, nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def steps(batch: pa.RecordBatch, name: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) pieces of whole documents of about ``limit`` bytes."""
    data, offsets = text_column(batch, name)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and the index of each document's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = ~IS_SPACE[data]
    begin = ink[1:-1] & ~ink[:-2]
    close = ink[1:-1] & ~ink[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[ink[cuts + 1] & ink[cuts]]
    begin[both] = True
    close[both - 1] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Prefix:
    """Hashes of any substring from prefix sums: sum of T[symbol] * B^position modulo 2^64, moved to position 0
    and mixed. Two families, seed 0 and 1, make a 128-bit identity."""

    _powers: dict = {}

    def __init__(self, seed: int):
        rng = np.random.default_rng(90001 + seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**58, 2**60)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.key = seed

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = Prefix._powers.get(self.key)
        if have is None or len(have[0]) < n:
            size = max(n, STEP_BYTES + 4096)
            up, down = np.full(size, np.uint64(self.base)), np.full(size, np.uint64(self.inverse))
            up[0] = down[0] = 1
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if size <= 4 * STEP_BYTES:
                Prefix._powers[self.key] = have
        return have

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: bytes, or 64-bit numbers that are hashed already."""
        values = self.table[symbols] if symbols.dtype == np.uint8 else symbols
        up, _ = self.powers(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(values * up[: len(symbols)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(sums) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


    def grams(self, symbols: np.ndarray, size: int) -> np.ndarray:
        """The hash of every ``size`` consecutive symbols."""
        sums = self.sums(symbols)
        _, down = self.powers(len(sums) + 1)
        out = sums[size:] - sums[: len(sums) - size]
        out *= down[: len(out)]
        out += np.uint64(size)
        return mix(out)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers between tasks, and both allocators keep what they had."""
    Prefix._powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(make: Callable) -> Callable:
    """For a function that makes a mapInArrow function: a task's memory goes back when it ends."""

    @functools.wraps(make)
    def made(*args, **options):
        run = make(*args, **options)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                give_back()

        return rows

    return made


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits (public-domain constants of a well-known avalanche function)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


FIRST, SECOND = Prefix(0), Prefix(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: Prefix = FIRST) -> np.ndarray:
    return family.of(family.sums(data), starts, ends)


def segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid end to end: each element's group, and its place in the group."""
    total = int(counts.sum())
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + count."""
    group, place = segments(counts)
    return np.asarray(starts)[group] + place


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling the width."""
    out, have = values, 1
    if len(out) < width:
        return out[:0]
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
