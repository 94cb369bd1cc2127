"""Anchors: the least-hashed gram of a window, which depends on nothing but the window."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15


def grams(hashed: np.ndarray, count: int) -> np.ndarray:
    """A hash of ``count`` symbols (a power of two) from each place on, given hashes of the symbols; the last places are left out."""
    with np.errstate(over="ignore"):
        factor, width = 0xD6E8FEB86659FD93, 1
        while width < count:
            hashed = hashed[:-width] * np.uint64(factor) + hashed[width:]
            factor, width = factor * factor % (1 << 64), 2 * width
        hashed = hashed ^ (hashed >> np.uint64(29))
        hashed *= np.uint64(MULTIPLIER)
        return hashed ^ (hashed >> np.uint64(32))


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` places that of the least hash, the leftmost of equals."""
    value, place, span = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while span < width:
        ahead = min(span, width - span)
        right = value[ahead:] < value[:-ahead]
        place = np.where(right, place[ahead:], place[:-ahead])
        value = np.minimum(value[ahead:], value[:-ahead])
        span += ahead
    return place
