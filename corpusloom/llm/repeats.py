"""Finding every window of L consecutive symbols (words or bytes) that occurs more than once in a corpus.

No shard is compared with all documents. Each window names an *anchor*: the smallest key (hash) of the grams of ``gram``
symbols inside it. Equal windows have equal anchors, so only windows under one anchor need comparing, and consecutive windows
under one occurrence of an anchor form one *segment*. Anchors only deal text
to shards; what repeats is said by an index over the shard's text:

1. anchors are counted (summed before the shuffle); those seen once are done with;
2. the segments of the others are joined in; equal segments (by hash) collapse into one with its number of copies
   and its first place;
3. the contents of the distinct segments are fetched from the documents, once each. Neighbours in a document whose
   anchors have no other content are written as one string, the others go to the shard of their anchor;
4. an operator's index over a shard of bounded size decides window by window;
5. removed ranges go back to their documents.

Hot keys. Grams that are frequent in a sample of the documents get a larger key than all others, so a window takes
one of them only if it holds nothing else: where a frequent passage stands in many contexts, the windows at its edges are
dealt by their contexts, and those inside it collapse into one segment. The sample changes where a window is compared, never
the result. Anchors that hold more than a fixed share of all segments (so there are few) are salted in both joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, SECOND, cut, discard, frugal, mix, most_frequent, segments, signed, spread, steps, window_min, word_hashes, words

#: Bytes of content that an index is built over at a time; one anchor's distinct segments are never parted.
SHARD_BYTES = 1 << 20
#: The sample that frequent grams are taken from: so many documents, and at least this share; seen so often there; at most so many.
SAMPLE, SHARE, OFTEN, FREQUENT = 4096, 1 / 256, 8, 1 << 18
#: Anchors with more than 1/HOT of all segments (fewer than HOT of them) are salted.
HOT, LEAST_HOT, SALTS = 4096, 1000, 64


@dataclass(frozen=True)
class Kind:
    unit: str  # "word" or "byte"
    length: int  # symbols in a window
    gram: int  # symbols in an anchor's gram
    keep_first: bool  # the first of equal windows stays


def symbols_of(kind: Kind, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents and each document's first; words as 64-bit hashes."""
    if kind.unit == "byte":
        return data, offsets
    starts, ends, first = words(data, offsets)
    return word_hashes(data, starts, ends), first


class Frequent:
    """A set of 64-bit numbers; a bit table answers for nearly all others."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.table = np.zeros(1 << 22, bool)
        self.table[self.values >> np.uint64(42)] = True

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = self.table[(x >> np.uint64(42)).view(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
            out[maybe] = self.values[at] == x[maybe]
        return out


def rightmost_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` keys (their upper 52 bits), its place modulo 4096 in the lower bits, inverted: of equal keys the
    rightmost is the smallest. Windows over a multiple of 4096 count places from another origin, else their order would turn there."""
    turn, half = np.uint64(0xFFF), np.uint64(2048)
    out = window_min((keys | turn) ^ (np.arange(len(keys), dtype=np.uint64) & turn), width)
    over = np.arange(4096, len(keys), 4096)
    if width < 2 or not len(over):
        return out
    if width > half:
        raise ValueError(f"width is at most {half}")
    span = over[:, None] + np.arange(1 - width, width - 1)  # the keys of the windows that hold a multiple and the place before it
    low = (np.append(keys, np.full(width, 2**64 - 1, np.uint64))[span] | turn) ^ ((span.astype(np.uint64) + half) & turn)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:, :-step], low[:, step:])
        have += step
    at = span[:, : width - 1]
    place = (((low & turn) ^ turn) - half) & turn
    inside = at < len(out)
    out[at[inside]] = ((low & ~turn) | (place ^ turn))[inside]
    return out


def anchored(kind: Kind, symbols: np.ndarray, first: np.ndarray, frequent: Frequent | None) -> tuple[np.ndarray, ...]:
    """(first window in the text, windows, anchor) of each segment."""
    n, size = len(symbols), kind.length
    if n < size:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = FIRST.grams(symbols, kind.gram)
    keys = grams
    if frequent is not None:
        keys = grams >> np.uint64(1)
        hot = frequent.holds(grams)
        keys[hot] |= np.uint64(1 << 63)
    low = rightmost_minima(keys, size - kind.gram + 1)
    change = np.empty(n - size + 2, bool)  # with the end of the last segment
    np.not_equal(low[1:], low[:-1], out=change[1:-1])
    change[0] = change[-1] = True
    bounds = np.concatenate([first, first[1:] - size + 1])  # documents, and the first windows that would leave them
    change[bounds[(bounds >= 0) & (bounds < len(change))]] = True
    edges = np.flatnonzero(change)
    begin, count = edges[:-1], np.diff(edges)
    inside = begin + size <= first[np.searchsorted(first, begin, "right")]
    begin, count = begin[inside], count[inside]
    return begin, count, signed(low[begin] >> np.uint64(12))


def segments_of(kind: Kind, data: np.ndarray, offsets: np.ndarray, frequent: Frequent | None = None) -> tuple[np.ndarray, ...]:
    """(document, anchor, content hash, first window, windows) arrays."""
    symbols, first = symbols_of(kind, data, offsets)
    begin, count, anchor = anchored(kind, symbols, first, frequent)
    doc = np.searchsorted(first, begin, "right") - 1
    content = SECOND.of(SECOND.sums(symbols), begin, begin + count + kind.length - 1)
    return doc, anchor, signed(content), begin - first[doc], count


def each_step(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
    for at, end, data, offsets in steps(batch, limit=1 << 20):
        yield ids[at:end], data, offsets


@frugal
def count_grams(kind: Kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in each_step(batch):
                symbols, first = symbols_of(kind, data, offsets)
                if len(symbols) < kind.gram:
                    continue
                grams = FIRST.grams(symbols, kind.gram)
                own = np.arange(len(grams)) + kind.gram <= np.repeat(first[1:], np.diff(first))[: len(grams)]
                got, n = np.unique(grams[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(got)), pa.array(n)], names=["gram", "n"])

    return run


def frequent_grams(docs: DataFrame, kind: Kind) -> Frequent | None:
    """The most frequent grams of a sample: at most ``FREQUENT`` numbers reach the driver."""
    share = min(1.0, max(SAMPLE / max(docs.count(), 1), SHARE))
    counted = docs.sample(share, seed=7).mapInArrow(count_grams(kind), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    counted = cut(counted, "frequent")
    values = most_frequent(counted, FREQUENT)[0].select("gram").toArrow().column(0).to_numpy()
    discard(counted)
    return Frequent(values.view(np.uint64)) if len(values) else None


@frugal
def count_anchors(kind: Kind, frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in each_step(batch):
                got, n = np.unique(anchored(kind, *symbols_of(kind, data, offsets), frequent.value)[2], return_counts=True)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n)], names=["anchor", "n"])

    return run


@frugal
def list_segments(kind: Kind, frequent, hot) -> Callable:
    """Segments with a salt: of a hot anchor they go to one of ``SALTS`` parts by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, offsets in each_step(batch):
                doc, anchor, content, first, count = segments_of(kind, data, offsets, frequent.value)
                if len(doc):
                    at = np.minimum(np.searchsorted(hot.value, anchor), max(len(hot.value) - 1, 0))
                    salted = hot.value[at] == anchor if len(hot.value) else np.zeros(len(anchor), bool)
                    salt = np.where(salted, (mix(ids[doc].astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0).astype(np.int32)
                    columns = (anchor, content, ids[doc], first, count.astype(np.int32), salt)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "content", "doc_id", "first", "count", "salt"])

    return run


#: A string of a shard: where it stands, and the segments written in it (place in the string, windows, copies).
STRINGS = "key long, doc_id long, begin long, text binary, parts array<struct<anchor:long,content:long,off:long,count:long,n:long>>"


@frugal
def fetch(kind: Kind) -> Callable:
    """Contents of the wanted segments from rows of one document with its text and the list of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            for at, end, data, offsets in steps(batch, limit=1 << 20):
                some = wanted.slice(at, end - at)
                flat = some.flatten()
                doc = np.repeat(np.arange(end - at), np.asarray(some.value_lengths()))
                anchor, content, n, first, count, shared = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                order = np.lexsort((first, doc))
                symbols, of = symbols_of(kind, data, offsets)
                stop = first + count + kind.length - 1
                fits = order[(stop <= np.diff(of)[doc])[order]]  # a row with this id but another text lacks the segment
                fits = fits[signed(SECOND.of(SECOND.sums(symbols), of[doc[fits]] + first[fits], of[doc[fits]] + stop[fits])) == content[fits]]
                doc, anchor, content, n, first, count, shared = (x[fits] for x in (doc, anchor, content, n, first, count, shared))
                if not len(doc):
                    continue
                new = np.ones(len(doc), bool)  # a string's first segment
                room = first // (4 * kind.length)
                new[1:] = (doc[1:] != doc[:-1]) | shared[1:] | shared[:-1] | (first[1:] != first[:-1] + count[:-1]) | (room[1:] != room[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(new)) - 1
                size = first[tail] + count[tail] + kind.length - 1 - first[head]
                if kind.unit == "byte":
                    begin = offsets[doc[head]] + first[head]
                    stop = begin + size
                else:
                    starts, ends, _ = words(data, offsets)
                    begin = starts[of[doc[head]] + first[head]]
                    stop = ends[of[doc[head]] + first[head] + size - 1]
                texts = [data[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                off = first - np.repeat(first[head], np.diff(np.append(head, len(new))))
                parts = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (anchor, content, off, count, n)], names=["anchor", "content", "off", "count", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(new)).astype(np.int32)), parts)
                key = np.where(shared[head], anchor[head], content[head])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at:end][doc[head]]), pa.array(first[head]), pa.array(texts, pa.binary()), lists], names=["key", "doc_id", "begin", "text", "parts"])

    return run


@dataclass
class Shard:
    """What an index is built over: strings, and the windows of the segments in them, segment after segment."""

    texts: list[bytes]
    string: np.ndarray  # of each segment
    off: np.ndarray  # first window of each segment in its string
    count: np.ndarray  # windows of each segment
    copies: np.ndarray  # of each segment
    doc: np.ndarray  # of each segment
    first: np.ndarray  # first window of each segment in its document

    def windows(self, base: np.ndarray) -> np.ndarray:
        """Places of all windows in a text where string i starts at base[i]."""
        seg, j = segments(self.count)
        return base[self.string[seg]] + self.off[seg] + j

    def weight(self, base: np.ndarray, size: int) -> np.ndarray:
        """How many copies stand at each place of the text; behind a string's last window as many as there."""
        last = np.zeros(len(base), np.int64)
        last[self.string] = self.copies
        out = np.repeat(last, np.diff(np.append(base, size)))
        out[self.windows(base)] = np.repeat(self.copies, self.count)
        return out

    def order(self) -> np.ndarray:
        """The windows' rank in the corpus by document and place."""
        seg, j = segments(self.count)
        out = np.empty(len(seg), np.int64)
        out[np.lexsort((self.first[seg] + j, self.doc[seg]))] = np.arange(len(seg))
        return out


def runs_of(gone: np.ndarray, begin: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    """Two list columns, a row a segment: starts and lengths of the runs of set windows."""
    new = np.zeros(len(gone), bool)
    new[begin] = True
    opens, closes = gone.copy(), gone.copy()
    opens[1:] &= ~gone[:-1] | new[1:]
    closes[:-1] &= ~gone[1:] | new[1:]
    run_from, run_to = np.flatnonzero(opens), np.flatnonzero(closes)
    seg = np.searchsorted(begin, run_from, "right") - 1
    off = pa.array(np.append(0, np.cumsum(np.bincount(seg, minlength=len(count)))).astype(np.int32))
    return [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int64))) for x in (run_from - begin[seg], run_to - run_from + 1)]


DECIDED = "anchor long, content long, again_at array<long>, again_n array<long>, later_at array<long>, later_n array<long>"


@frugal
def sharded(index: Callable[[Shard], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """Strings in the order of their keys, in shards of whole keys; index(shard) says of every window whether it occurs
    again, and whether it has an occurrence before its own place."""

    def decide(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        parts = t.column("parts").combine_chunks()
        flat = parts.flatten()
        anchor, content, off, count, n = (flat.field(k).to_numpy() for k in range(5))
        string = np.repeat(np.arange(len(t)), np.asarray(parts.value_lengths()))
        doc, begin = t.column("doc_id").to_numpy()[string], t.column("begin").to_numpy()[string]
        again, later = index(Shard(t.column("text").to_pylist(), string, off, count, n, doc, begin + off))
        at = np.cumsum(count) - count
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), *runs_of(again, at, count), *runs_of(later, at, count)], names=["anchor", "content", "again_at", "again_n", "later_at", "later_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            lengths = np.asarray(pc.binary_length(batch.column(3))).astype(np.int64)
            fresh = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            last, at = key[-1], 0
            for c in np.flatnonzero(fresh).tolist():
                if size + int(lengths[at:c].sum()) >= SHARD_BYTES:
                    if c > at:
                        held.append(batch.slice(at, c - at))
                    if held:
                        yield decide(held)
                    held, size, at = [], 0, c
            held.append(batch.slice(at))
            size += int(lengths[at:].sum())
        if held:
            yield decide(held)

    return run


def removed_ranges(docs: DataFrame, kind: Kind, index: Callable) -> DataFrame:
    """doc_id, ranges (array of (from, to) symbol ranges to remove, unordered and overlapping), anchors (segments whose anchor
    occurs more than once: a string of at least ``gram`` symbols in them is somewhere else, too)."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(docs, kind))
    counted = docs.mapInArrow(count_anchors(kind, frequent), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = cut(counted.where("n > 1"), "anchors")
    most = max(LEAST_HOT, (repeated.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT)
    salts = lambda on: F.explode(F.sequence(F.lit(0), F.when(on, SALTS - 1).otherwise(0)))
    hot = repeated.where(F.col("n") > most).select("anchor").toArrow().column(0).to_numpy()  # fewer than HOT numbers
    hot = spark.sparkContext.broadcast(np.sort(hot))
    found = docs.mapInArrow(list_segments(kind, frequent, hot), "anchor long, content long, doc_id long, first long, count int, salt int")
    kept = repeated.select("anchor", (F.col("n") > most).alias("hot"), salts(F.col("n") > most).alias("salt"))
    members = cut(found.join(kept, ["anchor", "salt"]), "segments")
    distinct = members.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "first", "count")).alias("at"), F.max("hot").alias("hot"))
    distinct = cut(distinct, "distinct")
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1").select("anchor", F.lit(True).alias("shared"))
    wanted = distinct.join(shared, "anchor", "left").select(F.col("at.doc_id").alias("doc_id"), F.struct("anchor", "content", "n", "at.first", F.col("at.count").cast("long").alias("count"), F.coalesce("shared", F.lit(False)).alias("shared")).alias("one"))
    lists = wanted.groupBy("doc_id").agg(F.collect_list("one").alias("wanted"))
    strings = docs.join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(fetch(kind), STRINGS)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    decided = strings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sharded(index), DECIDED)
    decided = decided.groupBy("anchor", "content").agg(*[F.first(c).alias(c) for c in ("again_at", "again_n", "later_at", "later_n")])  # rows may share an id
    known = distinct.select("anchor", "content", "at", "hot").join(decided, ["anchor", "content"]).withColumn("salt", salts(F.col("hot"))).drop("hot")
    row = members.drop("hot", "count").join(known, ["anchor", "content", "salt"])
    ranges = lambda at, n: F.zip_with(at, n, lambda o, r: F.struct((F.col("first") + o).alias("from"), (F.col("first") + o + r + (kind.length - 1)).alias("to")))
    gone = ranges("again_at", "again_n")
    if kind.keep_first:
        gone = F.when((F.col("at.doc_id") == F.col("doc_id")) & (F.col("at.first") == F.col("first")), ranges("later_at", "later_n")).otherwise(gone)
    out = cut(row.select("doc_id", gone.alias("gone")).groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("ranges"), F.count("*").alias("anchors")), "ranges")
    discard(repeated, members, distinct)
    return out


def merged(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mask over n symbols of the union of ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(begin, n), 1)
    np.add.at(step, np.minimum(end, n), -1)
    return np.cumsum(step[:-1]) > 0


@frugal
def digest(kind: Kind, with_text: bool, carried: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            ranges, anchors = (batch.column(batch.schema.get_field_index(c)) for c in ("ranges", "anchors"))
            for at, end, data, offsets in steps(batch, limit=1 << 20):
                kept_text, total, removed, spans, sha = [], [], [], [], []
                if kind.unit == "word":
                    starts, ends, of = words(data, offsets)
                for i in range(end - at):
                    some = ranges[at + i].values if ranges[at + i].is_valid else None
                    n = int(of[i + 1] - of[i]) if kind.unit == "word" else int(offsets[i + 1] - offsets[i])
                    gone = merged(n, some.field(0).to_numpy(), some.field(1).to_numpy()) if some is not None and n else np.zeros(n, bool)
                    if kind.unit == "byte":
                        own = data[offsets[i] : offsets[i + 1]]
                        kept = (own[~gone] if gone.any() else own).tobytes()
                    else:
                        left = np.flatnonzero(~gone) + of[i]
                        sizes = ends[left] - starts[left] + 1  # with the byte after it, then that byte becomes a space
                        raw = data[np.minimum(spread(starts[left], sizes), max(len(data) - 1, 0))]
                        if len(raw):
                            raw[np.cumsum(sizes) - 1] = 32
                        kept = raw[:-1].tobytes()
                    kept_text.append(kept if with_text else None)
                    total.append(n)
                    removed.append(int(gone.sum()))
                    spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                    sha.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)).slice(at, end - at) for c in carried), ids.slice(at, end - at), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept_text, pa.binary()), pa.array(sha, pa.string()), anchors.slice(at, end - at)],
                    names=[*carried, "doc_id", "total", "removed", "spans", "kept", "sha", "anchors"],
                )

    return run


def without_repeats(docs: DataFrame, kind: Kind, index: Callable, with_text: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, doc_id, total, removed, spans, kept (bytes, or null), sha, anchors of every document.

    ``anchors`` counts a document's places where a string of at least ``gram`` symbols occurs somewhere else, too, as far as windows have
    chosen them: a hint at repeats that are too short to go.

    Kept bytes may hold parts of characters where a removed range ends inside one. Null and empty texts stay empty. Rows
    with a null id are kept whole and match nothing; rows that share an id count as copies of one document and
    lose the same ranges. Texts of any length are searched whole; an empty table gives an empty result; other columns aren't read.
    """
    ranges = removed_ranges(docs, kind, index)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    schema = fields + ", " * bool(fields) + "doc_id long, total long, removed long, spans long, kept binary, sha string, anchors long"
    rows = docs.select(*carried, "doc_id", "text").join(ranges, "doc_id", "left").withColumn("anchors", F.coalesce("anchors", F.lit(0).cast("long")))
    return rows.mapInArrow(digest(kind, with_text, list(carried)), schema)
