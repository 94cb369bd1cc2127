"""Windows of words: where a text holds them, by which anchors, with which hashes. Words are ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tablepact.llm.anchors import MULTIPLIER, grams, least_places

#: Words of the grams among which a window has its anchor, a power of two.
GRAM = 4

FACTOR = 0xD6E8FEB86659FD93

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[text], [True]))))
    return edges[::2], edges[1::2]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word (there is one at least): a mix of every byte with its place in the word, added up and mixed."""
    letters, sizes = text[~SPACE[text]], ends - starts
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        mixed = ((np.arange(len(letters)) - np.repeat(first, sizes)) * 256 + letters + 1).astype(np.uint64) * np.uint64(MULTIPLIER)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(FACTOR)
        mixed ^= mixed >> np.uint64(29)
        total = np.add.reduceat(mixed, first) * np.uint64(MULTIPLIER)
        return total ^ (total >> np.uint64(32))


def pieces(texts: list[bytes], size: int, shard: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, start in it, bytes) of about ``shard`` bytes, in which every window of ``size`` words is found once."""
    held, total = [], 0
    for doc, text in enumerate(texts):
        at, width = 0, shard
        while at < len(text):
            part, following = text[at : at + width], len(text)
            if at + width < len(text):
                starts, ends = words_of(np.frombuffer(part, np.uint8))
                if len(starts) <= size:
                    width *= 2
                    continue
                # The last word may be cut: windows that hold it are left to the next piece.
                part, following = part[: ends[-2]], at + int(starts[-size])
            held.append((doc, at, part))
            total += len(part)
            if total >= shard:
                yield held
                held, total = [], 0
            at, width = following, shard
    if held:
        yield held


def stretches(shard: list[tuple[int, int, bytes]], size: int) -> tuple[np.ndarray, ...] | None:
    """(document, first byte, bytes, key, content hash) of halves of runs of windows with one anchor.

    All windows of a half share more than half of their words; the key is the hash of these.
    """
    whole = np.frombuffer(b"\n".join(part for _, _, part in shard), np.uint8)
    sizes = np.array([len(part) + 1 for _, _, part in shard])
    begins = np.cumsum(sizes) - sizes
    starts, ends = words_of(whole)
    if len(starts) < size:
        return None
    hashed = word_hashes(whole, starts, ends)
    gram = min(GRAM, 1 << (size.bit_length() - 1))
    anchor = least_places(grams(hashed, gram), size - gram + 1).astype(np.int64)
    piece = np.searchsorted(begins, starts, "right") - 1
    windows = np.flatnonzero(piece[: len(anchor)] == piece[size - 1 :])
    if not len(windows):
        return None
    own = anchor[windows]
    fresh = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    first, last, a = windows[fresh], windows[np.append(fresh[1:], len(windows)) - 1], own[fresh]
    reach = (size - gram + 1) // 2
    # Windows that begin at least ``reach`` before the anchor hold the words around it, the others those after it.
    cut = (first, np.minimum(last, a - reach), a - reach), (np.maximum(first, a - reach + 1), last, a)
    side = np.repeat([0, 1], len(first))
    first, last, core = (np.concatenate(both) for both in zip(*cut))
    some = first <= last
    first, end, core, side = first[some], last[some] + size, core[some], side[some]
    at = piece[first]
    docs, offsets = (np.array([part[i] for part in shard]) for i in (0, 1))
    x = starts[first]
    key = _run_hashes(hashed, core, core + size - reach) ^ np.array([0, FACTOR], np.uint64)[side]
    return docs[at], x - begins[at] + offsets[at], ends[end - 1] - x, key, _run_hashes(hashed, first, end)


def _run_hashes(hashed: np.ndarray, first: np.ndarray, end: np.ndarray, factor: int = FACTOR) -> np.ndarray:
    """A hash of each run of words, whatever stands before it: differences of one polynomial's sums, moved to its lowest power."""
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(len(hashed), factor, np.uint64))
        inverse = np.multiply.accumulate(np.full(len(hashed), pow(factor, -1, 1 << 64), np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * power)))
        found = (sums[end] - sums[first]) * inverse[first]
        found ^= found >> np.uint64(32)
        return found * np.uint64(MULTIPLIER)


def windows_of(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """All windows of ``size`` words: text, first byte, end, and two hashes."""
    whole = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.array([len(text) + 1 for text in texts])
    begins = np.cumsum(sizes) - sizes
    starts, ends = words_of(whole)
    if len(starts) < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashed = word_hashes(whole, starts, ends)
    piece = np.searchsorted(begins, starts, "right") - 1
    first = np.flatnonzero(piece[: len(starts) - size + 1] == piece[size - 1 :])
    at, end = piece[first], first + size
    hashes = (_run_hashes(hashed, first, end, factor) for factor in (FACTOR, MULTIPLIER))
    return at, starts[first] - begins[at], ends[end - 1] - begins[at], *hashes


def shared_windows(texts: list[bytes], docs: list[int], others: list[int], size: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of windows that two documents hold, overlapping ones of a text as one; a text has one document or another besides."""
    at, start, end, one, two = windows_of(texts, size)
    if not len(at):
        return []
    order = np.lexsort((two, one))
    fresh = np.flatnonzero(np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))))
    least = np.minimum.reduceat(np.array(docs)[at[order]], fresh)
    most = np.maximum.reduceat(np.array(others)[at[order]], fresh)
    shared = np.zeros(len(at), bool)
    shared[order] = np.repeat(least < most, np.diff(np.append(fresh, len(order))))
    at, start, end = at[shared], start[shared], end[shared]
    if not len(at):
        return []
    fresh = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] >= end[:-1]))))
    last = np.append(fresh[1:], len(at)) - 1
    return list(zip(at[fresh].tolist(), start[fresh].tolist(), end[last].tolist()))
