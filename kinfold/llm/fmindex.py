"""FM-index over a shard of symbols: suffix array, Burrows-Wheeler transform in
a wavelet matrix, backward search of many patterns at once, and location of
their occurrences by sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text, the suffix position is kept.
SAMPLE = 8


class BitRanks:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in [0, at)."""
        w, b = at >> 6, (at & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit of the symbol at each level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, s = [], symbols
        self.depth = max(1, int(sigma - 1).bit_length())
        for k in range(self.depth - 1, -1, -1):
            bit = ((s >> k) & 1).astype(bool)
            self.levels.append((k, BitRanks(bit), len(s) - int(bit.sum())))
            s = np.concatenate((s[~bit], s[bit]))
        # Where a symbol's part begins on the last level.
        self.origin = self._down(np.arange(sigma, dtype=np.int64), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in [0, at)."""
        return self._down(symbol, at) - self.origin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for k, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbol |= one.astype(np.int64) << k
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.origin[symbol]


def suffix_array(symbols: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes in order; symbol 0 ends a run, and an earlier 0 counts as the
    smaller. The last symbol must be 0. First as many symbols as fit one
    64-bit key are sorted, then what is still tied by doubling; a tie that
    reaches the end of its run is settled by the place of that end, so copies
    of a text cost no more rounds than their own length asks for."""
    n = len(symbols)
    bits = max(1, int(sigma - 1).bit_length())
    held = 62 // bits
    ends = np.flatnonzero(symbols == 0)
    end_of = ends[np.searchsorted(ends, np.arange(n))]  # the 0 at or after each place
    left = end_of - np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(held):
        key <<= bits
        m = max(0, n - j)
        key[:m] |= np.where(left[:m] >= j, symbols[n - m:], 0)
    order = np.argsort(key, kind="stable")  # stable: equal keys by place
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    # Tied suffixes whose run ended within the key stand in the order of their places, which is that of their ends.
    done = left[order] < held
    rank[order[done]] = np.flatnonzero(done)
    step = held
    # In the order of ranks; those of a tied group share it.
    group = np.concatenate((new[1:], [True])) & new
    tied = np.flatnonzero(~group & ~done)
    while len(tied):
        at = order[tied]
        over = left[at] < step
        then = np.where(over, end_of[at] - n, rank[np.minimum(at + step, n - 1)])  # ends before any rank, by place
        by = np.lexsort((then, rank[at]))
        at, then = at[by], then[by]
        order[tied] = at
        was = rank[at]
        new = np.concatenate(([True], (was[1:] != was[:-1]) | (then[1:] != then[:-1])))
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        tied = tied[~alone]
        step *= 2
    return order


class FMIndex:
    """Index of ``symbols`` (0 ends a run of symbols; the last is 0)."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_array(symbols, sigma)
        self.wavelet = WaveletMatrix(symbols[sa - 1].astype(np.int64), sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        # Starts of runs are kept too: no walk crosses an end.
        kept = (sa % sample == 0) | (symbols[sa - 1] == 0)
        self.marks, self.kept = BitRanks(kept), sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern. A
        pattern is a row of symbols (none 0) right-aligned in ``patterns``."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.first[-1], np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = live[(lengths[live] >= patterns.shape[1] - j) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, j]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes at ``rows``."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.marks.get(at[live])
            done = live[hit]
            out[done] = self.kept[self.marks.ones(at[done])] + steps[done]
            live = live[~hit]
            c, r = self.wavelet.access(at[live])
            at[live] = self.first[c] + r
            steps[live] += 1
        return out
