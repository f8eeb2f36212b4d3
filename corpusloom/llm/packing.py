"""Best-fit packing of tokenised documents by a linear grouping scheme.

The corpus is reduced to a histogram of piece lengths (at most one entry per length up to the capacity, so its
size doesn't depend on the corpus). On the driver the histogram is packed:

1. lengths above ``small`` are sorted and cut into groups of equal cardinality; every length is rounded up to the
   largest of its group, which leaves few sizes;
2. configurations of these sizes are optimised by column generation (a revised simplex whose pricing step is a
   knapsack), and rounded down;
3. each configuration's places are filled with actual lengths of its group;
4. what is left and the small pieces go best-fit, longest first, into the free space, then into new sequences.

The outcome is a table of runs: "the pieces of length L with ranks a to b go, k to a sequence, to the sequences
from s on, at offset o". Executors rank pieces within their length (partition-local ranks plus the sums of the
partitions before) and look their run up; no group of equal lengths is ever gathered.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Merges
from .common import cut, frugal, frugal, table, text_column

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
RUNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# ---------------------------------------------------------------- tokens


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes. The tokenizer treats white-space separated words
    independently, so each is merged once, many at a time, and remembered (up to ``most`` of them)."""

    def __init__(self, path: str, most: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(*(np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)), strict=True)))
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner, self.last = (np.array([vocab[sign[b] + x] for b in range(256)]) for x in ("", end))
        self.part = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.most = most
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def fold(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()

    def learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        plain = []
        for w in words:
            if b"<|" in w:  # may hold a special token: the library's own way
                into[w] = np.array(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                plain.append(w)
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            parts = [[x.encode() for x in self.part(self.fold(w.decode("utf-8", "replace")))] for w in some]
            flat = [x for p in parts for x in p]
            if not flat:
                into.update((w, b"") for w in some)
                continue
            sizes = np.array([len(x) for x in flat])
            raw = np.frombuffer(b"".join(flat), np.uint8)
            symbols = self.inner[raw]
            ends = np.cumsum(sizes) - 1
            symbols[ends] = self.last[raw[ends]]
            ids, lengths = self.merges.merge(symbols, sizes)
            raw_ids = ids.astype("<u4").tobytes()
            stop = np.append(0, 4 * np.cumsum(lengths))[np.append(0, np.cumsum([len(p) for p in parts]))].tolist()
            into.update((w, raw_ids[a:b]) for w, a, b in zip(some, stop, stop[1:], strict=False))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [t.split() for t in texts]
        wanted = set().union(*split)
        known = self.known
        new = list(wanted.difference(known))
        if len(known) + len(new) > self.most:  # a dictionary of these texts' own; it is the next memory if it may
            known = {w: known[w] for w in wanted if w in known}
            self.known = known if len(wanted) <= self.most else {}
        if new:
            self.learn(new, known)
        for part in split:
            yield b"".join([known[w] for w in part])


_words: dict[str, WordIds] = {}


@frugal
def tokenise(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = WordIds(path)
        words = _words[path]
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            data, offsets = text_column(batch)
            out: list[tuple] = []
            whole = memoryview(data)
            for at in range(0, len(ids), 256):
                stop = min(at + 256, len(ids))
                texts = [bytes(whole[offsets[i] : offsets[i + 1]]) for i in range(at, stop)]
                for doc, raw in zip(ids[at:stop], words.encode(texts), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        out.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, int(seen[length])))
                        seen[length] += 1
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


# ---------------------------------------------------------------- the plan


def grouped(counts: np.ndarray, small: int, groups: int) -> list[list[tuple[int, int]]]:
    """The lengths above ``small``, longest first, in groups of equal cardinality: lists of (length, count)."""
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1] if small < x < len(counts) - 1]
    total = int(counts[lengths].sum()) if lengths else 0
    out: list[list[tuple[int, int]]] = []
    if not total:
        return out
    quota, room = -(-total // groups), 0
    for length in lengths:
        left = int(counts[length])
        while left:
            if room == 0:
                out.append([])
                room = quota
            take = min(room, left)
            out[-1].append((length, take))
            room, left = room - take, left - take
    return out


def knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for g in np.argsort(-worth / np.array(sizes)):
        if worth[g] <= 1e-12:
            continue
        s = sizes[g]
        for base in range(s, capacity + 1, s):  # rows of width s: each sees the row before it, so any number fits
            stop = min(base + s, capacity + 1)
            with_one = best[base - s : stop - s] + worth[g]
            better = with_one > best[base:stop] + 1e-12
            best[base:stop][better] = with_one[better]
            last[base:stop][better] = g
    config, c = np.zeros(len(sizes)), int(np.argmax(best))
    value = best[c]
    left, gain = c, 0.0
    while left > 0 and last[left] >= 0 and gain < value + 1:
        g = int(last[left])
        config[g] += 1
        left -= sizes[g]
        gain += worth[g]
    return float((config * worth).sum()), config


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 500) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in an optimum of the relaxed problem."""
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        x = np.linalg.solve(basis, demand)
        duals = np.linalg.solve(basis.T, np.ones(m))
        value, column = knapsack(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, demand)
    return [(basis[:, k].copy(), float(x[k])) for k in range(m) if x[k] > 1e-9]


def pack(counts: np.ndarray, capacity: int = CAPACITY, small: int | None = None, groups: int = 48) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], int]:
    """Pack a histogram (counts[length], length 1 to capacity). Returns (contents, number of sequences alike)
    entries, contents being (length, copies) longest first, and the number of sequences."""
    counts = np.asarray(counts, np.int64).copy()
    small = capacity // 8 if small is None else small
    bins: list[tuple[dict[int, int], int]] = []
    rest = counts.copy()
    if counts[capacity]:
        bins.append(({capacity: 1}, int(counts[capacity])))
        rest[capacity] = 0
    parts = grouped(counts, small, groups)
    if parts:
        sizes = [p[0][0] for p in parts]
        demand = np.array([float(sum(n for _, n in p)) for p in parts])
        heaps = [list(reversed(p)) for p in parts]  # pop() gives the longest first
        merged: dict[int, int] = {}
        for g, s in enumerate(sizes):
            merged.setdefault(s, g)
        for config, times in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            left = int(times + 1e-9)
            slots = [g for g in range(len(sizes)) for _ in range(int(round(config[g])))]
            while left > 0 and slots:
                need = {g: slots.count(g) for g in set(slots)}
                if any(sum(n for _, n in heaps[g]) < k for g, k in need.items()):
                    break
                content: dict[int, int] = {}
                taken: dict[int, list[tuple[int, int]]] = {}
                many = left
                for g, k in need.items():  # the places of a group take its longest and shortest in turn
                    got: dict[int, int] = {}
                    line = heaps[g]
                    front, back = 0, len(line) - 1
                    have = {i: n for i, (_, n) in enumerate(line)}
                    for turn in range(k):
                        while back > front and have[back] <= 0:
                            back -= 1
                        while front < back and have[front] <= 0:
                            front += 1
                        i = back if turn % 2 == 0 else front
                        if have[i] <= 0:
                            i = front if have[front] > 0 else back
                        got[i] = got.get(i, 0) + 1
                        have[i] -= 1
                    taken[g] = [(i, c) for i, c in got.items()]
                    many = min([many, *(line[i][1] // c for i, c in got.items())])
                if many < 1:
                    break
                for g, picks in taken.items():
                    for i, c in picks:
                        length, n = heaps[g][i]
                        heaps[g][i] = (length, n - c * many)
                        content[length] = content.get(length, 0) + c
                        rest[length] -= c * many
                    heaps[g] = [x for x in heaps[g] if x[1] > 0]
                bins.append((content, many))
                left -= many
    free: list[list[list]] = [[] for _ in range(capacity + 1)]
    open_at = np.zeros(capacity + 1, bool)

    def put(content: dict[int, int], n: int) -> None:
        room = capacity - sum(k * c for k, c in content.items())
        free[room].append([content, n])
        open_at[room] = True

    for content, n in bins:
        put(content, n)
    for length in range(capacity, 0, -1):
        left = int(rest[length])
        while left:
            found = np.flatnonzero(open_at[length:])
            if len(found):
                room = length + int(found[0])
                content, n = free[room].pop()
                open_at[room] = bool(free[room])
            else:
                room, content, n = capacity, {}, left
            fit = min(room // length, left)
            many = min(n, left // fit)
            put(content | {length: content.get(length, 0) + fit}, many)
            if n > many and room < capacity:
                free[room].append([content, n - many])
                open_at[room] = True
            left -= fit * many
    out = [(tuple(sorted(c.items(), reverse=True)), n) for at in free for c, n in at]
    return out, sum(n for _, n in out)


def best_plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The scheme with a few thresholds and numbers of groups; the plan with the fewest sequences."""
    settings = [(4, 24), (4, 12), (4, 48), (8, 24), (2, 24)]
    plans = [pack(counts, capacity, capacity // part, groups) for part, groups in settings]
    return min(plans, key=lambda p: p[1])[0]


def runs(packed: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """Lookup arrays sorted by (length, first rank): see the module's text."""
    rows, next_rank, sequence = [], {}, 0
    for content, n in packed:
        offset = 0
        for length, copies in content:
            first = next_rank.get(length, 0)
            rows.append((length, first, copies, sequence, offset))
            next_rank[length] = first + copies * n
            offset += length * copies
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "copies", "sequence", "offset"), cols, strict=True))


def place(plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = (plan["length"] << 48) | plan["first"]
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        length, rank = (get(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
        at = np.searchsorted(key, (length << 48) | rank, "right") - 1
        nth = rank - plan["first"][at]
        sequence = plan["sequence"][at] + nth // plan["copies"][at]
        offset = plan["offset"][at] + nth % plan["copies"][at] * length
        yield pa.RecordBatch.from_arrays([*(get(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in RUNS.split(", ")])


# ---------------------------------------------------------------- operator and query


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Null and empty texts give a document of the end id alone. Longer documents are cut into pieces of the whole
    capacity and a rest. Other columns of ``docs`` aren't read; an empty table gives an empty result; equal
    documents and equal lengths are ordinary pieces.
    """
    pieces = cut(docs.select("doc_id", "text").mapInArrow(tokenise(tokenizer_path, capacity, end_id), PIECES), "pieces")
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    plan = docs.sparkSession.sparkContext.broadcast(runs(best_plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("base"))
    return ranked.mapInArrow(lambda it: place(plan.value, it), RUNS)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
