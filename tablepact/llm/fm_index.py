"""An FM-index over a sequence of symbols: backward search through wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so manieth position of the text is kept; the others are reached by steps back.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the length that is sorted."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        fresh = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        if n == 0 or fresh[-1] == n - 1:
            return order
        rank[order] = fresh
        width *= 2


class WaveletMatrix:
    """Ranks of any symbol before any place, a bit of the symbol at each level."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        current = symbols.astype(np.int64)
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (current >> bit) & 1
            before = np.zeros(len(current) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(current) - int(before[-1])
            self.levels.append((bit, before, zeros))
            current = np.concatenate([current[ones == 0], current[ones == 1]])

    def ranks(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before its ``place``."""
        start, end = np.zeros_like(place), place
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1) == 1
            start = np.where(one, zeros + before[start], start - before[start])
            end = np.where(one, zeros + before[end], end - before[end])
        return end - start


class FMIndex:
    """Finds all places of phrases in ``symbols`` (from 1 to ``largest``; 0 is the end)."""

    def __init__(self, symbols: np.ndarray, largest: int):
        text = np.r_[symbols.astype(np.int64), 0]
        order = suffix_order(text)
        self.last = text[order - 1]
        self.tree = WaveletMatrix(self.last, largest)
        self.below = np.searchsorted(np.sort(text), np.arange(largest + 2))
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; a row of ``phrases`` is padded at its end."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for back in range(phrases.shape[1]):
            active = np.flatnonzero((lengths > back) & (low < high))
            if not len(active):
                break
            symbol = phrases[active, lengths[active] - 1 - back]
            low[active] = self.below[symbol] + self.tree.ranks(symbol, low[active])
            high[active] = self.below[symbol] + self.tree.ranks(symbol, high[active])
        return low, np.maximum(low, high)

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to the nearest sampled one."""
        at, found = suffixes.copy(), np.full(len(suffixes), -1, np.int64)
        for steps in range(SAMPLE):
            hit = np.flatnonzero((found < 0) & self.sampled[at])
            found[hit] = self.samples[self.sample_rank[at[hit]]] + steps
            open_ = np.flatnonzero(found < 0)
            if not len(open_):
                break
            symbol = self.last[at[open_]]
            at[open_] = self.below[symbol] + self.tree.ranks(symbol, at[open_])
        return found
