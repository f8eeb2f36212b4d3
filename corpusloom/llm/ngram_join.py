"""Jaccard self-join of documents on word shingles by a grouped prefix join.

Two sets whose similarity reaches t share l elements among the first |x| - ceil(t |x|) + l of each, for l up to
ceil(t |x|), in any fixed order of elements; l is ``SHARED`` here, as chance meetings in one rare element are common. Rare elements first keeps candidates few; any order gives the same result, so frequencies need
only be good, not exact: elements seen twice or more within an input partition are summed over the corpus and the
most frequent ``FREQUENT`` are broadcast (a fixed bound of 8 MB).

1. equal sets collapse to one representative; representatives with equal prefixes and sizes form one group;
2. groups that share l prefix elements, with sizes that allow the threshold, are candidate pairs. In an element's list,
   sorted by size, a group that up to ``NEAR`` larger ones may reach is paired with each of them (a bounded number a
   row) and pairs are counted; what more may reach is a chain of links to leaders, one row a group, which count in
   full. A list that is long by chance holds groups of many sizes, so it is paired out whatever its length; only many
   groups of about one size, mostly copies, are chained. Candidates are closed into families;
3. families are expanded to members, whose whole sets are verified against each other. A family of up to ``BLOCK``
   members is one block. A larger one is dealt by size, each member to its band of sizes and the one below, and in
   three turns: blocks of a band by themselves; one member of each component found so far; then what is left to decide, which
   is pairs from different components. The family's largest component is sent once for each block of the other members, and those
   to each of its blocks; so a cluster of copies of any size costs a few times its members, not their square. Links
   inside a block leave it as a spanning forest;
4. forests are joined into components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, FIRST, LOWER, cut, frugal, mix, most_frequent, segments, sieve, signed, small_side, spread, steps, table, word_hashes, words
from .graph import components
from .oracles import jaccard_components as components_sql

FREQUENT = 1 << 19
BLOCK = 4096
#: Elements that a pair must share in its prefixes (fewer for tiny sets), and the longest list that is paired out.
SHARED, SHORT = 3, 32
#: Larger groups of a list that one group is paired with, at most; where sizes allow more, they are chained.
NEAR = 64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, laid end to end, and their numbers. A document of
    fewer words has them all as its one shingle."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    doc, place = segments(count)
    begin = first[doc] + place
    stop = np.minimum(begin + size, first[doc + 1])
    h = FIRST.of(FIRST.sums(word_hashes(data, starts, ends)), begin, stop)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(n_words))


@frugal
def local_frequencies(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            got, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(signed(got[some])), pa.array(n[some])], names=["shingle", "n"])

        for batch in batches:
            for _, _, data, offsets in steps(batch):
                h, _ = shingles(data, offsets, size)
                held.append(h)
                total += len(h)
                if total > 6_000_000:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return run


def running(x: np.ndarray) -> np.ndarray:
    """Sums before each place and in all, modulo 2^64."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared prefix elements that any pair at the threshold has, for the smaller size of the two."""
    return np.minimum(SHARED, least_overlap(n, percent))


@frugal
def candidates(percent: int) -> Callable:
    """Rows (token, n, gid) sorted so -> (u, v, need). Short lists give their pairs; a longer one is a chain of
    links to leaders, each leader followed by the sizes that may reach the one before. Plain form of
    :func:`near_candidates`, by the lists' lengths alone; the operator doesn't use it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(3)]
        open_run: list[int] | None = None  # token, leader and last size of a long list that goes on

        def leaders(token: int, n: np.ndarray, gid: np.ndarray) -> list[tuple[int, int]]:
            nonlocal open_run
            last, leader = (open_run[2], open_run[1]) if open_run and open_run[0] == token else (-1, -1)
            out = []
            opens = np.append(last * 100 < percent * n[0] or last < 0, n[:-1] * 100 < percent * n[1:])
            at = np.maximum.accumulate(np.where(opens, np.arange(len(n)), -1))
            lead = np.where(at >= 0, gid[np.maximum(at, 0)], leader)
            out += [(int(a), int(b)) for a, b in zip(gid, lead, strict=True) if a != b]
            open_run = [token, int(lead[-1]), int(n[-1])]
            return out

        def pairs(token: np.ndarray, n: np.ndarray, gid: np.ndarray, ends: bool) -> pa.RecordBatch | None:
            nonlocal held, open_run
            if not len(token):
                return None
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(begin, len(token)))
            chained: list[tuple[int, int]] = []
            if open_run and token[0] != open_run[0]:
                open_run = None
            going_on = open_run is not None
            short = length <= SHORT
            short[0] &= not going_on
            if not ends and short[-1]:  # its list may go on in the next rows
                held = [x[begin[-1] :] for x in (token, n, gid)]
                begin, length, short = begin[:-1], length[:-1], short[:-1]
            else:
                held = [x[:0] for x in (token, n, gid)]
            for k in np.flatnonzero(~short).tolist():
                a, b = begin[k], begin[k] + length[k]
                chained += leaders(int(token[a]), n[a:b], gid[a:b])
            rows = spread(begin[short & (length > 1)], length[short & (length > 1)])
            t, m, g = token[rows], n[rows], gid[rows]
            u, v, need = [], [], []
            for d in range(1, SHORT):
                if len(t) <= d:
                    break
                ok = (t[d:] == t[:-d]) & (m[:-d] * 100 >= percent * m[d:])
                if not (t[d:] == t[:-d]).any():
                    break
                u.append(np.maximum(g[:-d], g[d:])[ok])
                v.append(np.minimum(g[:-d], g[d:])[ok])
                need.append(needed(m[:-d], percent)[ok])
            first = np.array([a for a, _ in chained], np.int64)
            second = np.array([b for _, b in chained], np.int64)
            u, v = np.concatenate([*u, np.maximum(first, second)]).astype(np.int64), np.concatenate([*v, np.minimum(first, second)]).astype(np.int64)
            need = np.concatenate([*need, np.zeros(len(first), np.int64)]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(need)], names=["u", "v", "need"]) if len(u) else None

        for batch in batches:
            now = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            out = pairs(*now, ends=False)
            if out is not None:
                yield out
        out = pairs(*held, ends=True)
        if out is not None:
            yield out

    return run


@frugal
def near_candidates(percent: int, most: int = NEAR) -> Callable:
    """Rows (token, n, gid) sorted so -> (u, v, need). A row of whose list up to ``most`` later ones may reach its size is
    paired with each of them; else all that may are linked to one leader, which counts in full (need 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(3)]
        crowd: tuple[int, int, int] | None = None  # token, size of the last crowded row and its leader

        def links(token: np.ndarray, n: np.ndarray, gid: np.ndarray, end: int) -> pa.RecordBatch | None:
            """Of the first ``end`` rows; later ones are only looked at."""
            nonlocal crowd
            reach = lambda a, d: (token[a + d] == token[a]) & (n[a] * 100 >= percent * n[a + d])
            crowded = np.zeros(end, bool)
            far = np.arange(max(0, min(end, len(token) - most - 1)))
            crowded[: len(far)] = reach(far, most + 1)
            u, v, need = [], [], []
            left = np.flatnonzero(~crowded)
            for d in range(1, most + 1):
                left = left[left + d < len(token)]
                left = left[reach(left, d)]
                if not len(left):
                    break
                u.append(gid[left])
                v.append(gid[left + d])
                need.append(needed(n[left], percent))

            if crowd or crowded.any():
                # row 0 stands for the crowded row before these
                t, m, g = (np.append(np.int64(x), y[:end]) for x, y in zip(crowd or (0, -1, 0), (token, n, gid), strict=True))
                rows = np.arange(end + 1)
                last = np.maximum.accumulate(np.where(np.append(crowd is not None, crowded), rows, -1))
                before = np.append(-1, last[:-1])
                linked = (before >= 0) & (t[before] == t) & (m[before] * 100 >= percent * m)
                leader = g[np.maximum.accumulate(np.where(linked, -1, rows))]
                u.append(leader[linked])
                v.append(g[linked])
                need.append(np.zeros(int(linked.sum()), np.int64))
                crowd = (int(t[last[-1]]), int(m[last[-1]]), int(leader[-1])) if t[last[-1]] == t[-1] else None
            if not u:
                return None
            a, b = np.concatenate(u), np.concatenate(v)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(np.concatenate(need).astype(np.int64))], names=["u", "v", "need"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            end = len(held[0]) - most - 1
            if end > 0:
                out = links(*held, end)
                held = [x[end:] for x in held]
                if out is not None:
                    yield out
        if len(held[0]) and (out := links(*held, len(held[0]))) is not None:
            yield out

    return run


@frugal
def describe(size: int, percent: int, frequent) -> Callable:
    """doc_id, n, the set's identity, its prefix's identity and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = frequent.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, end, data, offsets in steps(batch):
                h, n = shingles(data, offsets, size)
                begin = np.cumsum(n) - n
                doc = np.repeat(np.arange(len(n)), n)
                order_key = np.zeros(len(h), np.int64)
                if len(known) and len(h):
                    slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[slot] == h
                    order_key[hit] = rank[slot[hit]]
                h = h[np.argsort((doc << 32) | order_key, kind="stable")]
                k1, k2 = (running(mix(h + np.uint64(salt))) for salt in (1, 0x9E3779B97F4A7C15))
                prefix = np.where(n > 0, n - least_overlap(n, percent) + needed(n, percent), 0)
                pick = spread(begin, prefix)
                p1 = running(mix(h[pick] + np.uint64(77)))
                p_end = np.cumsum(prefix)
                over = lambda c, a, b: signed(mix(c[b] - c[a]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, p_end).astype(np.int32)), pa.array(signed(h[pick])))
                cols = [ids.slice(at, end - at), pa.array(n.astype(np.int64)), pa.array(over(k1, begin, begin + n)), pa.array(over(k2, begin, begin + n)), pa.array(over(p1, p_end - prefix, p_end)), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "k1", "k2", "g", "prefix"])

    return run


#: Where a member is compared: a family's band, a pair of blocks (or one), its own of the two, what it is known to be linked to.
PLACE = "family long, band long, a long, b long, own long, rep long, label long, shingles array<long>"


@frugal
def expand(size: int) -> Callable:
    """A member's text to its set, once for each of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, places = (batch.column(batch.schema.get_field_index(k)) for k in ("rep", "places"))
            for at, end, data, offsets in steps(batch):
                h, n = shingles(data, offsets, size)
                begin = np.cumsum(n) - n
                some = places.slice(at, end - at)
                doc = np.repeat(np.arange(end - at), np.asarray(some.value_lengths()))
                flat = some.flatten()
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[doc])).astype(np.int32)), pa.array(signed(h[spread(begin[doc], n[doc])])))
                family, band, a, b, own, label = (flat.field(k) for k in range(6))
                yield pa.RecordBatch.from_arrays([family, band, a, b, own, rep.slice(at, end - at).take(pa.array(doc)), label, lists], names=["family", "band", "a", "b", "own", "rep", "label", "shingles"])

    return run


def forest(rep: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what pairs at the threshold connect (within one block, or across two); members with the same
    ``known`` are linked already."""
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((rep, sizes))
    label = np.arange(len(rep)) if known is None else np.unique(known, return_inverse=True)[1][order]
    sizes, rep, block = sizes[order], rep[order], block[order]
    flat = np.concatenate([sets[i] for i in order.tolist()]) if len(sets) else np.zeros(0, np.int64)
    ids = np.unique(flat, return_inverse=True)[1]
    begin = np.cumsum(sizes) - sizes
    across = block.min() != block.max()
    flag = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    links = []
    for x in range(len(rep) - 1):
        stop = int(np.searchsorted(sizes, sizes[x] * 100 // percent, "right"))
        near = np.arange(x + 1, stop)
        near = near[label[near] != label[x]]
        if across:
            near = near[block[near] != block[x]]
        if not len(near):
            continue
        own = ids[begin[x] : begin[x] + sizes[x]]
        flag[own] = True
        for k in range(0, len(near), 512):
            some = near[k : k + 512]
            some = some[label[some] != label[x]]
            if not len(some):
                continue
            shared = np.add.reduceat(flag[ids[spread(begin[some], sizes[some])]].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for y in some[100 * shared >= percent * (sizes[x] + sizes[some] - shared)].tolist():
                if label[y] != label[x]:
                    links.append((int(rep[x]), int(rep[y])))
                    label[label == label[y]] = label[x]
        flag[own] = False
    return links


@frugal
def compare(percent: int) -> Callable:
    """Rows sorted by (family, band, a, b); one pair of blocks in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rep, block, known, sets = None, [], [], [], []

        def verified() -> list[pa.RecordBatch]:
            links = forest(np.array(rep), np.array(block), sets, percent, np.array(known)) if len(rep) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["u", "v"])] if links else []

        for batch in batches:
            family, band, a, b, own, reps, label = (batch.column(k).to_numpy() for k in range(7))
            lists = batch.column(7)
            values, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            change = np.flatnonzero(np.append(True, (family[1:] != family[:-1]) | (band[1:] != band[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            for lo, hi in zip(change.tolist(), [*change[1:].tolist(), len(family)], strict=True):
                now = (int(family[lo]), int(band[lo]), int(a[lo]), int(b[lo]))
                if now != key:
                    yield from verified()
                    key, rep, block, known, sets = now, [], [], [], []
                rep += reps[lo:hi].tolist()
                block += own[lo:hi].tolist()
                known += label[lo:hi].tolist()
                sets += [values[off[i] : off[i + 1]].copy() for i in range(lo, hi)]
        yield from verified()

    return run


def verified(docs: DataFrame, placed: DataFrame, size: int, percent: int) -> DataFrame:
    """u, v: links between members (rep) that share a place (family, band, a, b, own, label)."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(placed, "placed")
    lists = placed.groupBy("rep").agg(F.collect_list(F.struct("family", "band", "a", "b", "own", "label")).alias("places"))
    texts = docs.withColumnRenamed("doc_id", "rep")
    if placed.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    else:  # the join shuffles, but not the texts of documents that have no place
        texts = sieve(texts, "rep", placed.select("rep")).where("maybe").drop("maybe")
    texts = texts.join(lists, "rep")
    rows = texts.select("rep", "text", "places").mapInArrow(expand(size), PLACE)
    return cut(rows.repartition(parts, "family", "band", "a", "b").sortWithinPartitions("family", "band", "a", "b").mapInArrow(compare(percent), "u long, v long"), "verified")


def in_blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with the number of blocks of their group and their block."""
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    return rows.join(small_side(blocks, "blocks"), list(keys)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))


def numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    return members.drop("label").join(components(links).select(F.col("node").alias("rep"), F.col("root").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def large_family_links(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """u, v: links that connect the members (family, rep, n) of families of more than ``BLOCK``."""
    # sizes of a linked pair fall into one band or two neighbours, as a band is a little wider than the threshold's ratio
    band = F.floor(F.log(F.col("n").cast("double")) / (1.01 * math.log(100 / percent))).cast("long") if percent < 100 else F.col("n")
    banded = cut(members.select("family", "rep", F.explode(F.array(band, band - 1)).alias("band")), "banded")
    place = lambda rows, a, b, own: rows.select("family", "band", "rep", "label", a.alias("a"), b.alias("b"), own.alias("own"))

    own_label = in_blocks(banded.withColumn("label", F.col("rep")), "family", "band")
    links = verified(docs, place(own_label, F.col("block"), F.col("block"), F.col("block")), size, percent)
    # one member of each component, all sizes together: a link found here is as good as any
    some = with_roots(members.select("family", "rep"), links).groupBy("family", "label").agg(F.min("rep").alias("rep")).withColumns({"band": F.lit(0).cast("long"), "label": F.col("rep")})
    some = in_blocks(some, "family", "band")
    links = links.unionByName(verified(docs, place(some, F.col("block"), F.col("block"), F.col("block")), size, percent))

    rooted = cut(with_roots(members.select("family", "rep"), links), "rooted")
    sizes = rooted.groupBy("family", "label").agg(F.count("*").alias("members"))
    main = sizes.groupBy("family").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("components")).where("components > 1")
    rows = banded.join(rooted, ["family", "rep"]).join(small_side(main, "main"), "family").withColumn("side", F.when(F.col("label") == F.col("main"), 0).otherwise(1))
    rows = cut(in_blocks(rows, "family", "band", "side"), "sides")
    count = lambda side: small_side(rows.where(F.col("side") == side).groupBy("family", "band").agg(F.max("blocks").alias("others")), "counts")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    largest = rows.where("side = 0").join(count(1), ["family", "band"]).withColumn("other", numbers(F.col("others")))
    others = rows.where("side = 1").join(count(0), ["family", "band"]).withColumn("other", numbers(F.col("others")))
    among = rows.where("side = 1").withColumn("other", numbers(F.col("blocks")))
    left = place(largest, F.col("block"), -1 - F.col("other"), zero).unionByName(place(others, F.col("other"), -1 - F.col("block"), one))
    left = left.unionByName(place(among, F.least("block", "other"), F.greatest("block", "other"), F.col("block")))
    return links.unionByName(verified(docs, left, size, percent))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and empty texts have no shingles and are linked with nothing; equal texts are linked. Rows with a null id
    get a null component and link nothing; rows that share an id are one document's versions and each linked by
    its own text. Texts of any length are taken whole; other columns aren't read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counted = docs.mapInArrow(local_frequencies(size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = most_frequent(cut(counted.where("n > 3"), "frequencies"), FREQUENT)[0].toArrow()  # at most FREQUENT rows
    known, n = top.column("shingle").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(known)
    rank = 1 + np.argsort(np.argsort(n, kind="stable"))
    frequent = spark.sparkContext.broadcast((known[order], rank[order]))

    sets = cut(docs.mapInArrow(describe(size, percent, frequent), "doc_id long, n long, k1 long, k2 long, g long, prefix array<long>"), "sets")
    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    reps = named.groupBy("k1", "k2", "n", "g").agg(F.min("doc_id").alias("rep"))
    groups = named.groupBy("g", "n").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("at")).select("g", "n", F.col("at.doc_id").alias("gid"), F.col("at.k1").alias("gk1"), F.col("at.k2").alias("gk2"))
    heads = named.join(groups.select("gid", "gk1", "gk2"), (F.col("doc_id") == F.col("gid")) & (F.col("k1") == F.col("gk1")) & (F.col("k2") == F.col("gk2")))
    tokens = heads.select(F.explode("prefix").alias("token"), "n", "gid")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = tokens.select("token", "n", "gid").repartition(parts, "token").sortWithinPartitions("token", "n", "gid")
    near = listed.mapInArrow(near_candidates(percent), "u long, v long, need long").groupBy("u", "v").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    edges = near.where("shared >= need").select("u", "v")
    families = components(edges)

    members = reps.join(groups.select("g", "n", "gid"), ["g", "n"]).join(families.select(F.col("node").alias("gid"), "root"), "gid", "left")
    members = cut(members.select("rep", "n", "k1", "k2", F.coalesce("root", "gid").alias("family")), "members")
    sizes = cut(members.groupBy("family").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    many = sizes.where(F.col("size") > BLOCK).select("family")
    rest, links = members, None
    if not many.isEmpty():  # a hot family isn't dealt by its key
        many = small_side(many, "large-families")
        links = large_family_links(docs, cut(members.join(many, "family").select("family", "rep", "n"), "large"), size, percent)
        rest = members.join(many, "family", "left_anti")
    zero = F.lit(0).cast("long")
    small = rest.join(sizes.where(F.col("size") <= BLOCK), "family")
    small = verified(docs, small.select("family", "rep", F.col("rep").alias("label"), zero.alias("band"), zero.alias("a"), zero.alias("b"), zero.alias("own")), size, percent)
    links = small if links is None else links.unionByName(small)
    found = components(links)

    named_reps = members.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("component_id"))
    out = sets.select("doc_id", "n", "k1", "k2").join(named_reps, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
ORACLE_SQL = {"op5_ngram_jaccard_join": components_sql(3, 90)}
