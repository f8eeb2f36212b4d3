"""A Burrows-Wheeler transform and what can be asked of it, in numpy: backward search over a wavelet matrix,
common prefixes by breadth-first interval expansion, places from sampled positions.

The text is an array of symbols from 0 up; 0 is a sentinel that ends each string of the text, and no answer
reaches beyond one.
"""

from __future__ import annotations

import numpy as np

from .common import spread


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key among the distinct ones, the order of the keys)."""
    order = np.argsort(key)
    ahead = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(ahead[1:], ahead[:-1], out=new[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order


def moved(x: np.ndarray, by: int) -> np.ndarray:
    """x shifted to the left, zeros behind."""
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of text in the order of their first ``depth`` symbols at least; the order runs on beyond sentinels,
    which are equal.

    As many symbols as a 63-bit number holds are sorted at once, then ranks are combined by threes (twos in a long
    text).
    """
    bits = max(1, int(text.max(initial=0)).bit_length())
    have = max(1, min(63 // bits, depth))
    key = text.astype(np.int64)
    for k in range(1, have):
        key = (key << bits) | moved(text, k)
    rank, order = ranked(key)
    while have < depth and rank[order[-1]] < len(text) - 1:
        width = int(rank.max() + 1).bit_length()
        parts = 3 if 3 * width <= 63 else 2
        key = rank + 1
        for k in range(1, parts):
            key = (key << width) | moved(rank + 1, k * have)
        rank, order = ranked(key)
        have *= parts
    return order


class WaveletMatrix:
    """rank of any symbol over a sequence, in one packed bit row a level."""

    def __init__(self, sequence: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        n, current = len(sequence), sequence
        self.rows, self.counts, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.rows.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1])
            self.zeros.append(int(n - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        at = np.zeros(alphabet, np.int64)
        every = np.arange(alphabet)
        for k in range(self.bits):
            at = np.where((every >> (self.bits - 1 - k)) & 1, self.zeros[k] + self.ones(k, at), at - self.ones(k, at))
        self.origin = at

    def ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        return self.counts[k][word] + np.bitwise_count(self.rows[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            ones = self.ones(k, i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i - self.origin[symbol]

    def parts(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct symbols of all ranges: (symbol, rank at the range's start, rank at its end)."""
        symbol = np.zeros(len(lo), np.int64)
        for k in range(self.bits):
            both = self.ones(k, np.concatenate([lo, hi]))
            low, high = both[: len(lo)], both[len(lo) :]
            one, zero = high > low, hi - high > lo - low
            symbol = np.concatenate([symbol[zero] * 2, symbol[one] * 2 + 1])
            lo, hi = np.concatenate([(lo - low)[zero], self.zeros[k] + low[one]]), np.concatenate([(hi - high)[zero], self.zeros[k] + high[one]])
        start = self.origin[symbol]
        return symbol, lo - start, hi - start


class FMIndex:
    """Backward search over a text, exact for patterns of up to ``depth`` symbols.

    ``weight`` says how often the string that holds a place stands for itself; ``copies(lo, hi)`` is what the rows of an
    interval weigh. With ``sampled`` only every so many-th place is kept (``depth`` must be the text's length then).
    """

    def __init__(self, text: np.ndarray, depth: int, weight: np.ndarray, sampled: int = 0):
        sa = suffix_array(text, depth)
        self.n = len(text)
        self.weights = np.append(0, np.cumsum(weight[sa]))
        self.bwt = text[sa - 1]
        alphabet = int(text.max(initial=0)) + 1
        self.wavelet = WaveletMatrix(self.bwt, alphabet)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=alphabet)))[:-1]
        if sampled:  # a string's first place is kept too, as no step leads beyond it
            keep = (sa % sampled == 0) | (self.bwt == 0)
            self.marked = np.flatnonzero(keep)
            self.kept = sa[keep]
        else:
            self.sa = sa

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have ``symbol`` in front of what the rows lo to hi start with."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.before[symbol] + both[: len(lo)], self.before[symbol] + both[len(lo) :]

    def copies(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weights[hi] - self.weights[lo]

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows start."""
        out, at, steps, who = np.empty(len(rows), np.int64), rows, 0, np.arange(len(rows))
        while len(at):
            k = np.minimum(np.searchsorted(self.marked, at), len(self.marked) - 1)
            there = self.marked[k] == at
            out[who[there]] = self.kept[k[there]] + steps
            at, who = at[~there], who[~there]
            symbol = self.bwt[at]
            at = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out

    def common_prefixes(self, most: int) -> np.ndarray:
        """How many symbols each row's suffix shares with the row before it, ``most`` where it is that or more.

        Breadth first: round k takes the intervals of strings of k symbols whose right end was new in the round
        before, puts every symbol that precedes them in front, and gives the new intervals' right ends, where
        no smaller value stands yet, the value k. So values appear in increasing order and the expansion stops at
        ``most``. No string is extended by the sentinel.
        """
        found = np.full(self.n + 1, most, np.int32)
        found[0] = 0
        hi = np.append(self.before[1:], self.n)
        lo = self.before
        some = hi > lo
        lo, hi = lo[some], hi[some]
        found[hi] = 0
        back = np.empty(self.n, np.int64)  # the row with the preceding symbol in front, for intervals of one row
        back[np.argsort(self.bwt, kind="stable")] = np.arange(self.n)
        for value in range(1, most):
            one = hi - lo == 1
            single = lo[one]
            single = single[self.bwt[single] > 0]
            symbol, low, high = self.wavelet.parts(lo[~one], hi[~one])
            real = symbol > 0
            symbol = symbol[real]
            lo = np.concatenate([back[single], self.before[symbol] + low[real]])
            hi = np.concatenate([back[single] + 1, self.before[symbol] + high[real]])
            new = found[hi] == most
            lo, hi = lo[new], hi[new]
            if not len(hi):
                break
            found[hi] = value
        return found[: self.n]


def intervals(common: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each interval of suffixes that share ``length`` symbols, the interval of each row)."""
    new = common < length
    new[:1] = True
    return np.flatnonzero(new), np.cumsum(new) - 1


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of symbols (from 1 up) with a sentinel behind each, and where each starts."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int64)
    if len(texts):
        out[spread(base, sizes - 1)] = np.concatenate(texts)
    return out, base
