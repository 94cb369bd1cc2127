"""SimHash near-duplicates, with a Gray-order hierarchical index.

Two fingerprints that differ in at most two of 64 bits agree in at least two of any four blocks of
bits. The upper level of the index are these shared masked patterns: six masks of two blocks each, and a group of
fingerprints for every pattern under a mask. A group of more than ``GROUP`` fingerprints is parted again, by two of
four blocks of the bits still free; after three levels only eight bits are free, so no group is ever larger.
Within a group the fingerprints stand in Gray order, where neighbours share most bits. Nodes over runs of
neighbours hold the bits that all of the run share; a search drops the whole run when the
differences in these bits are already too many, and otherwise goes on to the finer nodes.

Groups yield a spanning set of links instead of all pairs; copies with one fingerprint are one entry throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.shared import arrow_pass, components, marker, rows, stored, utf8, whole_numbers

SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

#: Shingles of a text whose bits are added at a time.
CHUNK = 1 << 16

#: Words of a shingle.
SIZE = 3

#: Links join fingerprints that differ in at most so many bits.
DISTANCE = 2

#: Fingerprints that one group of the index holds at most.
GROUP = 256

BLOCKS = 4

#: Entries below a node of the index.
FANOUT = 8


def fingerprint(text: bytes, size: int = SIZE) -> int:
    """The SimHash of the text's word shingles, repeats included; 0 without words."""
    words = WORD.findall(text.lower())
    if not words:
        return 0
    shingles = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, shingles, CHUNK):
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(start, min(shingles, start + CHUNK))),
            np.uint64,
        )
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles).tobytes(), "big", signed=True)


def level_masks(level: int) -> list[int]:
    """The masks of a level: each of the level before, and two of the four blocks of the bits it leaves free."""
    if level == 0:
        return [0]
    out = []
    for mask in level_masks(level - 1):
        free = [bit for bit in range(64) if not mask >> bit & 1]
        blocks = [free[len(free) * i // BLOCKS : len(free) * (i + 1) // BLOCKS] for i in range(BLOCKS)]
        out += [mask | sum(1 << bit for i in pair for bit in blocks[i]) for pair in combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    return out


TABLES = len(level_masks(1))


def gray_rank(fingerprint: Column) -> Column:
    """Place of a bit pattern in Gray order (as a signed number, which only turns the two halves round)."""
    rank = fingerprint
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


class GrayIndex:
    """A hierarchical index over distinct fingerprints in Gray order."""

    def __init__(self, ordered: np.ndarray):
        self.leaves = ordered
        self.levels = []
        pattern, mask = ordered, np.full(len(ordered), ~np.uint64(0))
        while len(pattern) > 1:
            starts = np.arange(0, len(pattern), FANOUT)
            both = np.bitwise_and.reduceat(mask, starts)
            ones, any_ = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            pattern, mask = ones, both & ~(ones ^ any_)
            self.levels.append((pattern, mask))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of places i < j within the distance."""
        n = len(self.leaves)
        query, node = np.arange(n), np.zeros(n, np.int64)
        sizes = [n, *[len(p) for p, _ in self.levels]]
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[level]
            near = np.bitwise_count((self.leaves[query] ^ pattern[node]) & mask[node]) <= DISTANCE
            query, node = query[near], node[near]
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            query = np.repeat(query, FANOUT)
            there = node < sizes[level]
            query, node = query[there], node[there]
        kept = (query < node) & (np.bitwise_count(self.leaves[query] ^ self.leaves[node]) <= DISTANCE)
        return query[kept], node[kept]


def spanning(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """For every entry that a pair joins to others, a link to the smallest id it is joined with."""
    root = np.arange(len(ids))
    while len(first):
        # The smaller id of two joined trees becomes the root of the larger.
        a, b = root[first], root[second]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        best = np.lexsort((ids[a], b))
        b, a = b[best], a[best]
        fresh = np.r_[True, b[1:] != b[:-1]]
        root[b[fresh]] = a[fresh]
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return list(zip(ids[root[moved]].tolist(), ids[moved].tolist()))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group; groups arrive one after the other, each in Gray order."""
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(fingerprints: list[int], ids: list[int]):
        if len(ids) > 1:
            first, second = GrayIndex(np.array(fingerprints, np.int64).view(np.uint64)).pairs()
            yield from spanning(first, second, np.array(ids, np.int64))

    group, fingerprints, ids, out = None, [], [], []
    for batch in batches:
        for table, key, own, least in zip(*(c.to_pylist() for c in batch.columns)):
            if (table, key) != group:
                out += found(fingerprints, ids)
                group, fingerprints, ids = (table, key), [], []
            fingerprints.append(own)
            ids.append(least)
        if len(out) > 10_000:
            yield rows(links, {"a": [a for a, _ in out], "b": [b for _, b in out]})
            out = []
    out += found(fingerprints, ids)
    yield rows(links, {"a": [a for a, _ in out], "b": [b for _, b in out]})


def near_links(classes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints that join all that are within the distance.

    ``classes`` has the columns fingerprint and least; an id for each fingerprint.
    """
    entries, links = classes.select("fingerprint", "least", F.lit(0).alias("table")), None
    for level in (1, 2, 3):
        masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in level_masks(level)])
        spread = entries.select(
            "fingerprint", "least", F.explode(F.expr(f"sequence(table * {TABLES}, table * {TABLES} + {TABLES - 1})")).alias("table")
        ).withColumn("key", F.col("fingerprint").bitwiseAND(F.get(masks, F.col("table"))))
        shared = stored(spread.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
        small = shared.where(F.col("n") <= group) if level < 3 else shared
        grouped = spread.join(small.select("table", "key"), ["table", "key"]).select("table", "key", "fingerprint", "least")
        # Adaptive execution may split a join; the groups are brought together once more.
        ordered = grouped.repartition("table", "key").sortWithinPartitions("table", "key", gray_rank(F.col("fingerprint")))
        own = ordered.mapInArrow(_search, "a long, b long")
        links = own if links is None else links.unionAll(own)
        large = shared.where(F.col("n") > group)
        if level == 3 or large.isEmpty():
            break
        entries = spread.join(large.select("table", "key"), ["table", "key"]).select("fingerprint", "least", "table")
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: component_id is the smallest id reachable by links.

    A fingerprint is the 64-bit SimHash of the ``size``-word shingles of the text, A-Z lower-cased; words are
    parted by white space of ASCII. It is given as a signed long. Fingerprints that differ in at most ``DISTANCE``
    bits are linked, equal ones too.

    * Null and empty texts, and those without words, have fingerprint zero, and are linked like any other.
    * Texts of fewer than ``size`` words have one shingle. Very long texts are hashed whole, some shingles at a time.
    * Ids are whole numbers; another type raises ValueError.
    * Rows that repeat an id are entries of their own. Rows without an id get the component of their fingerprint,
      null if no row of it has an id.
    * Only the two named columns are read. An empty table gives an empty table.
    """
    kind = whole_numbers(docs, doc_id)

    def mark(batch: pa.RecordBatch):
        prints = pa.array([fingerprint(raw, size) for raw in utf8(batch.column(1))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "fingerprint"])

    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = stored(arrow_pass(named, mark, f"doc_id {kind}, fingerprint long"), "fingerprints")
    classes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("least")), "classes")
    joined = components(near_links(classes.where("least is not null"), group))
    placed = classes.join(joined, classes["least"] == joined["id"], "left").select(
        "fingerprint", F.coalesce("component", "least").cast(kind).alias("component_id")
    )
    return marked.join(placed, "fingerprint").select("doc_id", "fingerprint", "component_id")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: the one of the smallest id, and any one of those that share it.

    * Rows are told apart by their number, not by their id: repeated rows and shared ids are rows like any others. Rows
      without an id come last: one stays only if no row of its group has an id. Ids may be of any type with an order.
    * Null and empty texts, and those without words, are one group.
    * The columns are those of ``docs``. An empty table gives an empty table.
    """
    number = marker(docs, "row")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(number).alias("row"), F.col(text).alias("text")), "row", "text", size)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    ids = numbered.select(F.col(number).alias("row"), F.col(doc_id).alias("id"))
    grouped = found.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    kept = grouped.groupBy("component_id").agg(F.min(order)["row"].alias(number)).select(number)
    return numbered.join(kept, number, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


def fingerprint_text(fingerprint: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
