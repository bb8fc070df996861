"""An FM-index over a bounded shard of integer symbols, searched in numpy for many patterns at once.

Symbol 0 separates runs. Every 0 is a distinct sentinel ordered by its position, so suffix comparisons stop
at the first separator and the sort never goes deeper than the longest run.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of `text` (values 0..sigma-1, 0 = separator) by packed prefixes and rank doubling."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    bits, place = max(1, int(sigma - 1).bit_length()), max(1, int(n - 1).bit_length())
    take = max(1, (64 - place) // bits)
    key = np.zeros(n, dtype=U64)
    alive = np.ones(n, dtype=bool)  # no separator so far
    wide = text.astype(U64)
    for j in range(take):
        key <<= U64(bits)
        if j < n:
            here = wide[j:]
            alive[n - j :] = False
            key[: n - j] |= np.where(alive[: n - j], here, U64(0))
            alive[: n - j] &= here > 0
    low = (U64(1) << U64(place)) - U64(1)
    packed = np.sort((key << U64(place)) | np.arange(n, dtype=U64))
    order = (packed & low).astype(np.int64)
    head = packed >> U64(place)
    new = np.ones(n, dtype=bool)
    # a prefix that holds a separator is already unique: equal keys stay in order of position
    new[1:] = (head[1:] != head[:-1]) | ~alive[order[1:]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    depth = take
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        where = order[slots]
        ahead = where + depth
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((where, second, group[slots]))
        where, second, first = where[by], second[by], group[slots][by]
        order[slots] = where
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[slots] = fresh
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = group
        depth *= 2


class Bits:
    """A bit vector with constant-time rank: one popcount prefix for each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(U64)) & U64(1)).astype(bool)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks and symbols of a sequence over 0..sigma-1, one bit vector for each symbol bit."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            vector = Bits(bit)
            self.levels.append((vector, len(values) - vector.ones))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before position i."""
        start = np.zeros_like(i)
        for k, (vector, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = vector.rank1(start), vector.rank1(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for vector, zeros in self.levels:
            one = vector.get(i)
            a = vector.rank1(i)
            out = (out << 1) | one
            i = np.where(one, zeros + a, i - a)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        order = suffix_order(text, sigma)
        self.n = len(text)
        bwt = text[order - 1]  # the first suffix is preceded by the last symbol, a separator by contract
        self.tree = WaveletMatrix(bwt, sigma)
        self.first = np.zeros(sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        kept = (order % sample == 0) | (bwt == 0)  # a walk never has to cross a separator
        self.marked = Bits(kept)
        self.sampled = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows padded on the right): half-open suffix ranges."""
        m = len(lengths)
        lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        last = patterns[np.arange(m), lengths - 1]
        lo[:], hi[:] = self.first[last], self.first[last + 1]
        for step in range(2, int(lengths.max(initial=0)) + 1):
            act = np.flatnonzero((lengths >= step) & (hi > lo))
            if not len(act):
                break
            c = patterns[act, lengths[act] - step]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[act], hi[act]]))
            lo[act] = self.first[c] + both[: len(act)]
            hi[act] = self.first[c] + both[len(act) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk back until a sampled suffix."""
        out = np.empty(len(rows), dtype=np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.marked.get(at)
            out[left[hit]] = self.sampled[self.marked.rank1(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            if len(left):
                c = self.tree.access(at)
                at = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out
