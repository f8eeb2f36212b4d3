"""Byte-pair merging of many words at once in flat numpy arrays.

A round finds, for each word, its best pair (lowest rank; the leftmost of equal ranks) with one segmented
minimum, merges that pair in all words at once, and compacts the arrays; words without a pair left are done.
This is the sequential algorithm word by word, so results equal those of the usual libraries. Words of more than
``LONG`` symbols would need that many rounds and take a heap instead, as exact and near-linear.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 256
NONE = np.int64(2**62)


class Merges:
    """Pair -> (rank, merged symbol), as an open-addressed hash table over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        self.bits = max(10, int(len(key) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.merged = np.full(size, NONE, np.int64), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(key)), self.slot(key)
        while len(todo):
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]] = key[todo[put]]
            self.rank[slot[put]], self.merged[slot[put]] = rank[todo[put]], merged[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (size - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs, -1 where the pair doesn't merge (negative symbols never do)."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self.slot(key)
        got = self.keys[slot]
        out = np.where(got == key, slot, -1)
        out[(left < 0) | (right < 0)] = -1
        todo = np.flatnonzero((got != key) & (got != -1))
        probe = slot[todo]
        while len(todo):
            probe = (probe + 1) & (len(self.keys) - 1)
            got = self.keys[probe]
            hit = got == key[todo]
            out[todo[hit]] = probe[hit]
            on = ~hit & (got != -1)
            todo, probe = todo[on], probe[on]
        out[(left < 0) | (right < 0)] = -1
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.find(left, right)
        return np.where(slot >= 0, self.rank[slot], NONE)

    def long_word(self, symbols: list[int]) -> list[int]:
        """One word by a heap of (rank, place)."""
        n = len(symbols)
        value, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        known: dict[tuple[int, int], tuple[int, int] | None] = {}

        def look(pairs: list[tuple[int, int]]) -> None:
            new = list({p for p in pairs if p not in known})
            if new:
                a, b = np.array(new, np.int64).T
                for p, s in zip(new, self.find(a, b).tolist(), strict=True):
                    known[p] = (int(self.rank[s]), int(self.merged[s])) if s >= 0 else None

        look(list(zip(value, value[1:], strict=False)))
        heap = [(known[p][0], i, p) for i, p in enumerate(zip(value, value[1:], strict=False)) if known[p]]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or (value[i], value[j]) != p:
                continue
            value[i] = known[p][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0:
                    q = (value[a], value[b])
                    look([q])
                    if known[q]:
                        heapq.heappush(heap, (known[q][0], a, q))
        return [v for v, a in zip(value, alive, strict=True) if a]

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of the words laid end to end, and the words' new lengths."""
        counts = np.asarray(counts, np.int64)
        begins = np.cumsum(counts) - counts
        done_symbols: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        done_counts: list[np.ndarray] = []

        def finish(sym: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
            done_symbols.append(sym)
            done_words.append(word)
            done_counts.append(n)

        for w in np.flatnonzero(counts > LONG).tolist():
            got = np.array(self.long_word(symbols[begins[w] : begins[w] + counts[w]].tolist()), np.int64)
            finish(got, np.array([w]), np.array([len(got)]))
        word = np.flatnonzero((counts <= LONG) & (counts > 0))
        n = counts[word]
        own = np.repeat((counts <= LONG), counts)
        sym = symbols[own].astype(np.int64)
        if len(sym):
            rank = np.full(len(sym), NONE, np.int64)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[np.cumsum(n) - 1] = NONE
            while True:
                begin = np.cumsum(n) - n
                low = np.minimum.reduceat(rank, begin)
                live = low < NONE
                if not live.all():
                    keep = np.repeat(live, n)
                    finish(sym[~keep], word[~live], n[~live])
                    sym, rank, word, n, low = sym[keep], rank[keep], word[live], n[live], low[live]
                    if not len(word):
                        break
                    begin = np.cumsum(n) - n
                hit = np.flatnonzero(rank == np.repeat(low, n))
                owner = np.searchsorted(begin, hit, "right") - 1
                first = np.ones(len(hit), bool)
                first[1:] = owner[1:] != owner[:-1]
                at = hit[first]  # one place a word
                slot = self.find(sym[at], sym[at + 1])
                sym[at] = self.merged[slot]
                gone = at + 1
                keep = np.ones(len(sym), bool)
                keep[gone] = False
                rank[at] = NONE
                sym, rank = sym[keep], rank[keep]
                at = at - np.arange(len(at))
                n = n - 1
                ends = np.cumsum(n) - 1
                begin = ends + 1 - n
                right = at < ends
                rank[at[right]] = self.ranks(sym[at[right]], sym[at[right] + 1])
                left = at > begin
                rank[at[left] - 1] = self.ranks(sym[at[left] - 1], sym[at[left]])
        lengths = np.zeros(len(counts), np.int64)
        if not done_words:
            return np.zeros(0, np.int64), lengths
        words, sizes, flat = (np.concatenate(x) for x in (done_words, done_counts, done_symbols))
        lengths[words] = sizes
        order = np.argsort(words, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        from .common import spread

        return flat[spread(starts, sizes[order])], lengths
