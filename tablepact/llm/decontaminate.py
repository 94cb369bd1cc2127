"""Benchmark decontamination by an FM-index per shard of documents.

A shard is one Arrow batch. Its words become symbols: words of the benchmark keep their number, runs
of such words too short to hold any window are left out, and runs are kept apart. All windows of the
benchmark are then searched backwards at once, their places located, and the places merged to spans.
Documents never move: the operator is one map over them for each block of the benchmark.

The benchmark is handed to the tasks in blocks of about ``block_bytes`` of text, so what a task holds
has a bound; a benchmark of several blocks takes as many passes over the documents, in one plan.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.fm_index import FMIndex
from tablepact.llm.shared import marker, rows, utf8

#: Words of lower-cased UTF-8: digits, a-z and everything outside ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

STATE = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"

SHARD_BYTES = 1 << 21


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Windows:
    """The distinct windows of a block of benchmark items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], length: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple, set] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for start in range(max(1, len(symbols) - length + 1) if symbols else 0):
                windows.setdefault(tuple(symbols[start : start + length]), set()).add(item)
        self.items = [sorted(names - {None}) for names in windows.values()]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.phrases = np.zeros((len(windows), length), np.int64)
        for row, window in zip(self.phrases, windows):
            row[: len(window)] = window
        self.shortest = int(self.lengths.min()) if len(windows) else 0


def runs_of(numbers: np.ndarray, owner: np.ndarray, shortest: int) -> np.ndarray:
    """Places of the words that stand in runs of at least ``shortest`` benchmark words of one document."""
    known = numbers > 0
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (known[1:] != known[:-1])]
    run = np.cumsum(fresh) - 1
    return np.flatnonzero(known & (np.bincount(run)[run] >= shortest))


def occurrences(numbers: np.ndarray, owner: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, word place) of all occurrences in a shard; ``owner`` is each word's document."""
    nothing = np.array([], np.int64)
    kept = runs_of(numbers, owner, windows.shortest) if len(numbers) and len(windows.phrases) else nothing
    if not len(kept):
        return nothing, nothing
    parted = np.r_[False, (np.diff(kept) != 1) | (owner[kept][1:] != owner[kept][:-1])]
    place = np.arange(len(kept)) + np.cumsum(parted)
    breaker = len(windows.vocabulary) + 1
    symbols = np.full(place[-1] + 1, breaker, np.int64)
    symbols[place] = numbers[kept]
    source = np.zeros(len(symbols), np.int64)
    source[place] = kept
    index = FMIndex(symbols, breaker)
    low, high = index.search(windows.phrases, windows.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    suffixes = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
    return which, source[index.locate(suffixes)]


def hit_spans(which: np.ndarray, place: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` words, whether an occurrence covers it."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, place, 1)
    np.add.at(delta, place + lengths[which], -1)
    return np.cumsum(delta[:-1]) > 0


def scan_shard(texts: list[bytes], windows: Windows) -> tuple[list[int], list[list[tuple]], list[list[str]]]:
    """Per document: number of words, merged spans (first word, end), items found."""
    number = windows.vocabulary.get
    words = [words_of(text) for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    numbers = np.fromiter((number(w, 0) for ws in words for w in ws), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    which, place = occurrences(numbers, owner, windows)
    spans: list[list[tuple]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if len(which):
        hit = hit_spans(which, place, windows.lengths, len(numbers))
        before = np.r_[False, hit[:-1] & (owner[1:] == owner[:-1])]
        after = np.r_[hit[1:] & (owner[1:] == owner[:-1]), False]
        for s, e in zip(np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)):
            spans[owner[s]].append((int(s - first[owner[s]]), int(e + 1 - first[owner[s]])))
        for doc, window in np.unique(np.stack([owner[place], which]), axis=1).T:
            items[doc].update(windows.items[window])
    return sizes.tolist(), spans, [sorted(i) for i in items]


def merged(spans: list[tuple]) -> list[tuple]:
    """Overlapping and touching spans as one."""
    out: list[list] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(s) for s in out]


def shards(texts: list[bytes]):
    """Ranges of rows of about ``SHARD_BYTES`` of text."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SHARD_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = 10,
    block_bytes: int = 1 << 23,
) -> DataFrame:
    """``docs`` with n_words, spans and items.

    Words are runs of digits, a-z (A-Z lower-cased) and characters outside ASCII. A window is
    ``length`` consecutive words of an item, or all words of an item that has fewer. ``spans``
    are the merged stretches of a document (first word, end) that occurrences of windows cover;
    ``items`` the sorted ids, as text, of the items with occurring windows.

    * Null and empty texts have no words, no spans and no items; items without words match nothing.
    * Items that share an id count as one item; an item without an id marks words, but is not listed.
    * Rows of ``docs`` that repeat an id are judged each for itself.
    * Columns named n_words, spans or items are replaced; other columns stay as they are.
    * Without documents the result is empty; without items nothing is found.
    """
    rest = [c for c in docs.columns if c not in (text, "n_words", "spans", "items")]
    body = F.struct(F.lit(True).alias(marker(docs)), *[F.col(f"`{c}`") for c in rest])
    current = docs.select(
        body.alias("rest"),
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first:long,end:long>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    shape = current.schema["rest"].dataType.simpleString()
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for block in range(blocks):
        found = items.where(part == block).collect()
        windows = Windows([(r.item, (r.text or "").encode()) for r in found], length)
        current = current.mapInArrow(_scan(windows), f"rest {shape}, text string, {STATE}")
    return current.select(F.col("text").alias(text), *[F.col(f"rest.`{c}`") for c in rest], "n_words", "spans", "items")


def _scan(windows: Windows):
    state = pa.schema(
        [
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            ("items", pa.list_(pa.string())),
        ]
    )

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            for start, end in shards(texts):
                part = batch.slice(start, end - start)
                sizes, spans, items = scan_shard(texts[start:end], windows)
                for i, (old, names) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())):
                    if old or names:
                        spans[i] = merged(spans[i] + [(s["first"], s["end"]) for s in old])
                        items[i] = sorted({*items[i], *names})
                pairs = [[{"first": a, "end": b} for a, b in own] for own in spans]
                done = rows(state, {"n_words": sizes, "spans": pairs, "items": items})
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), part.column("text"), *done.columns], names=["rest", "text", *state.names]
                )

    return run
