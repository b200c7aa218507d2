"""Suffix order, Burrows-Wheeler transform and wavelet ranks of one bounded block.

Blocks have at most ``BLOCK`` symbols, so a sort key and a position fit one
64-bit integer and every sort is a plain sort of numbers.
"""

from __future__ import annotations

import numpy as np

_BITS = 21
BLOCK = 1 << 20
_POS = np.int64((1 << _BITS) - 1)
_ONE = np.uint64(1)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of ``keys`` (below 2**42), and where in it each run of equal keys begins."""
    packed = np.sort((keys << _BITS) | np.arange(len(keys)))
    new = np.ones(len(keys), bool)
    new[1:] = (packed[1:] >> _BITS) != (packed[:-1] >> _BITS)
    return packed & _POS, new


def dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number 64-bit ``values`` 0, 1, ... in ascending order: the distinct values, and each one's number."""
    order, new = _ranked((values >> np.uint64(22)).astype(np.int64))
    ordered = values[order]
    if not np.array_equal(new[1:], ordered[1:] != ordered[:-1]):  # the upper bits alone do not tell all apart
        return np.unique(values, return_inverse=True)
    ids = np.empty(len(values), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ordered[new], ids


def suffix_order(symbols: np.ndarray, keys: np.ndarray, depth: int, limit: int | None = None) -> np.ndarray:
    """Suffix positions of ``symbols`` in order, by prefix doubling.

    ``keys`` (below 2**42) order the suffixes by their first ``depth`` symbols.
    The block ends with a symbol found nowhere else, and suffixes are read
    cyclically, so all differ. With a ``limit`` they are ordered by at least
    their first ``limit`` symbols, and need not differ.
    """
    n = len(symbols)
    sa, new = _ranked(keys)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while not new.all() and (limit is None or depth < limit):
        lone = new & np.append(new[1:], True)
        at = np.flatnonzero(~lone)
        here = sa[at]
        next_rank = rank[(here + depth) % n]
        group = rank[here]
        dense_group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
        order, fresh = _ranked((dense_group << _BITS) | next_rank)
        here = here[order]
        sa[at] = here
        new[at] = fresh
        rank[here] = np.maximum.accumulate(np.where(fresh, at, 0))
        depth *= 2
    return sa


class WaveletMatrix:
    """Ranks of symbols 0 .. ``sigma`` - 1 in a sequence, one packed bit vector per level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.sigma = len(symbols), sigma
        self.shifts = list(range(max(1, int(sigma - 1).bit_length())))[::-1]
        self.words, self.blocks, self.zeros = [], [], []
        rest = symbols.astype(np.int32)
        for shift in self.shifts:
            bit = ((rest >> shift) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.words.append(words)
            self.blocks.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.first = np.zeros(sigma, np.int64)
        if self.n:
            new = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
            self.first[rest[new]] = new
        counts = np.bincount(symbols, minlength=sigma)
        self.smaller = np.cumsum(counts) - counts

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.blocks[level][word] + np.bitwise_count(self.words[level][word] & below)

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: rows smaller than ``symbols`` in order, plus their count in front of ``at``."""
        to = at
        for level, shift in enumerate(self.shifts):
            ones = self._ones(level, to)
            to = np.where((symbols >> shift) & 1, self.zeros[level] + ones, to - ones)
        return self.smaller[symbols] + to - self.first[symbols]

    def last_to_first(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix one position to the left of each row's."""
        to, symbols = rows, np.zeros(len(rows), np.int64)
        for level in range(len(self.shifts)):
            word = to >> 6
            bit = ((self.words[level][word] >> (to & 63).astype(np.uint64)) & _ONE).astype(bool)
            symbols = (symbols << 1) | bit
            ones = self._ones(level, to)
            to = np.where(bit, self.zeros[level] + ones, to - ones)
        return self.smaller[symbols] + to - self.first[symbols]

    def extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All backward steps of row ranges [low, high): whose each is, and its range."""
        owner, symbols = np.arange(len(low)), np.zeros(len(low), np.int64)
        for level in range(len(self.shifts)):
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            zero_low, zero_high = low - ones_low, high - ones_high
            left, right = zero_high > zero_low, ones_high > ones_low
            zeros = self.zeros[level]
            owner = np.concatenate([owner[left], owner[right]])
            symbols = np.concatenate([symbols[left] << 1, (symbols[right] << 1) | 1])
            low = np.concatenate([zero_low[left], ones_low[right] + zeros])
            high = np.concatenate([zero_high[left], ones_high[right] + zeros])
        shift = self.smaller[symbols] - self.first[symbols]
        return owner, low + shift, high + shift
