"""A compressed FM-index over a sequence of integer symbols, with batched matching statistics."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with the number of zeros before any position: one machine word and one counter for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = int(len(bits) - bits.sum())

    def ones_before(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Matching statistics, up to `order` symbols, of streamed stretches of a sequence of symbols of 0 and more.

    The sequence ends with 0, and stretches hold no 0. What is kept is compressed: the
    Burrows-Wheeler transform as a wavelet tree (a bit for each symbol and level, with rank counters),
    a bit for each row that begins a group of rows with equal first `order - 1` or `order` symbols,
    and for each group of the latter the least value of its rows. Suffixes and their places are not.
    """

    def __init__(self, symbols: np.ndarray, values: np.ndarray, order: int):
        rank, short = sorted_rows(symbols, order)
        rows, group = rank
        n, top = len(symbols), int(symbols.max(initial=0))
        self.order, self.size = order, n
        self.groups, self.wide = (BitRank(np.concatenate([[1], x[1:] != x[:-1]]).astype(np.uint8)) for x in (group, short[rows]))
        self.wide_starts = np.append(np.nonzero(np.concatenate([[True], short[rows][1:] != short[rows][:-1]]))[0], n)
        self.least = np.minimum.reduceat(values[rows], np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])[:-1]
        self.levels, now = [], symbols[rows - 1].astype(np.int64)
        self.bits = max(top.bit_length(), 1)
        for level in reversed(range(self.bits)):
            bit = (now >> level & 1).astype(np.uint8)
            self.levels.append(BitRank(bit))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.offset = self.before - self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(reversed(range(self.bits)), self.levels):
            ones = bits.ones_before(at)
            at = np.where((symbols >> level & 1).astype(bool), bits.zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the rows that begin with a symbol and then with what the ranges given begin with."""
        both = self._descend(np.concatenate([symbols, symbols]), np.concatenate([lo, hi])) + np.concatenate([self.offset[symbols]] * 2)
        return both[: len(lo)], both[len(lo) :]

    def least_of_windows(self, stretches: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The least value over all occurrences of each window of `order` symbols, stretch by stretch, from left to right.

        A stretch is stretches[end - length : end]; it is in the sequence and at least `order` long.
        Backward search carries each stretch's match from symbol to symbol: below `order` it grows,
        and from there the range first widens to that of its first `order - 1` symbols.
        """
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[order], lengths[order]
        counts = lengths - self.order + 1
        begin = np.empty(len(order) + 1, np.int64)
        begin[0], begin[1:] = 0, np.cumsum(counts[np.argsort(order, kind="stable")])
        begin = begin[order]
        out = np.empty(int(counts.sum()), np.int64)
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64)
        for t in range(int(lengths.max(initial=0))):
            k = int(np.searchsorted(-lengths, -t, "left"))
            lo, hi = lo[:k], hi[:k]
            if t >= self.order:
                g = self.wide.ones_before(lo + 1) - 1
                lo, hi = self.wide_starts[g], self.wide_starts[g + 1]
            lo, hi = self.step(stretches[ends[:k] - 1 - t], lo, hi)
            if t >= self.order - 1:
                out[begin[:k] + lengths[:k] - 1 - t] = self.least[self.groups.ones_before(lo + 1) - 1]
        return out


def _rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of each pair among the distinct ones; equal pairs share one."""
    n = len(a)
    place, high, low = max(n - 1, 1).bit_length(), int(a.max()).bit_length(), int(b.max()).bit_length()
    if place + high + low > 63:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if high + low <= 63 else np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)[1].reshape(-1)
    packed = np.sort((a << low | b) << place | np.arange(n))
    key = packed >> place
    out = np.empty(n, np.int64)
    out[packed & ((1 << place) - 1)] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
    return out


def sorted_rows(symbols: np.ndarray, order: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((places sorted by their first `order` symbols, the group of each), the rank of each place by its first `order - 1`); beyond the end all is 0."""
    symbols = symbols.astype(np.int64)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        out[: max(len(x) - by, 0)] = x[by:]
        return out

    ranks = {1: symbols}
    short, length = np.zeros(len(symbols), np.int64), 0
    while length < order - 1:
        step = 1
        while 2 * step + length <= order - 1:
            if 2 * step not in ranks:
                ranks[2 * step] = _rank_pairs(ranks[step], shifted(ranks[step], step))
            step *= 2
        short = _rank_pairs(short, shifted(ranks[step], length)) if length else ranks[step]
        length += step
    last = _rank_pairs(short, shifted(symbols, length))
    rows = np.argsort(last, kind="stable")
    return (rows, last[rows]), short
