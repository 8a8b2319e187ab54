"""A compressed full-text index over sequences of small integers.

Suffix order by prefix doubling, the Burrows-Wheeler transform in a wavelet
matrix of packed bits with a rank directory, backward search, and positions by
sampled suffixes. All queries take arrays and are answered together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order.

    The last symbol must be the only smallest one. With ``depth``, suffixes
    are ordered by at least their first ``depth`` symbols, which is all that
    counting patterns of that length needs.
    """
    n = len(s)
    # the first sort already looks at as many symbols as one integer holds
    bits = max(1, int(s.max()).bit_length())
    k, key = min(n, max(1, 62 // bits)), np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits
        key[: n - i] |= s[i:]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[sa] = np.cumsum(np.r_[0, key[sa][1:] != key[sa][:-1]])
    while rank[sa[-1]] < n - 1 and (depth is None or k < depth):
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        # only suffixes whose rank is shared need sorting again
        size = np.bincount(rank, minlength=n)
        tied = size[rank[sa]] > 1
        part = sa[tied]
        part = part[np.argsort(key[part], kind="stable")]
        sa[tied] = part
        ordered = key[sa]
        rank[sa] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        k *= 2
    return sa


class Bits:
    """A bit vector with constant-time rank: packed words and a count for each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.uint32)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:], dtype=np.uint32)
        self.zeros = int(len(bits) - np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Backward search over a sequence that ends with its only 0.

    Kept are the wavelet matrix and, with ``sample``, each ``sample``-th suffix
    position; without it patterns can be counted but not located.
    """

    def __init__(self, s: np.ndarray, sigma: int, sample: int | None = 16, depth: int | None = None):
        n = len(s)
        sa = suffix_array(s, depth)
        bwt = s[sa - 1]  # position -1 is the closing 0
        self.n, self.sigma = n, sigma
        self.levels: list[tuple[int, Bits]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> shift) & 1 == 1
            self.levels.append((shift, Bits(ones)))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        counts = np.bincount(s, minlength=sigma)
        symbols = np.arange(sigma, dtype=np.int64)
        first = np.cumsum(counts) - counts
        #: added to what the wavelet matrix returns, it gives the row in suffix order
        self.shift = first - self._walk(symbols, np.zeros(sigma, np.int64))
        if sample:
            marked = sa % sample == 0
            self.marked, self.samples = Bits(marked), sa[marked].astype(np.int64)

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            r = bits.rank(i)
            i = np.where((c >> shift) & 1 == 1, bits.zeros + r, i - r)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Row reached from row boundary i by putting symbol c in front."""
        return self.shift[c] + self._walk(c, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each pattern: a matrix of symbols, -1 for unused places at the front."""
        m, k = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for j in range(k - 1, -1, -1):
            live = np.flatnonzero((hi > lo) & (patterns[:, j] >= 0))
            c = patterns[live, j]
            both = self.step(np.r_[c, c], np.r_[lo[live], hi[live]])
            lo[live], hi[live] = both[: len(live)], both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-order rows: walk back until a sampled one."""
        rows = rows.astype(np.int64)
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = self.marked.get(rows)
            out[todo[here]] = self.samples[self.marked.rank(rows[here])] + steps
            todo, rows = todo[~here], rows[~here]
            c, i = np.zeros(len(rows), np.int64), rows
            for shift, bits in self.levels:
                one = bits.get(i)
                r = bits.rank(i)
                c |= one.astype(np.int64) << shift
                i = np.where(one, bits.zeros + r, i - r)
            rows = self.shift[c] + i
            steps += 1
        return out
