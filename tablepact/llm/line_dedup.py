"""Line deduplication across documents, with two Bloom filters.

One filter takes the hashes of line keys seen once, the other those seen again. The filters are cut
into segments by hash; a segment is built in one task from hashes that every task has made distinct
before the shuffle, so a line that is everywhere arrives once per batch. The second filter is then
given to all tasks. Only lines it suspects leave their task: their keys are confirmed exactly, and the
smallest document is chosen, by one aggregate. Documents then meet the keys they lose, and are rebuilt.

The filter that all tasks get has at most ``filter_bytes`` bytes, whatever the input. Past some
``filter_bytes`` repeated lines it suspects more and more lines that are single; these are shuffled and
found single, so the result stays the same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.shared import arrow_pass, marker, rows, stored, utf8, whole_numbers

BLANKS = b" \t\n\x0b\x0c\r"

#: Hashes that one segment of the filters is made for.
SEGMENT_LINES = 1 << 17

#: Bits set for a key, in either filter.
PROBES = 4


def line_keys(text: bytes, min_length: int) -> list[bytes | None]:
    """The key of every line; None for lines whose key is too short to be compared."""
    keys = []
    for line in text.split(b"\n"):
        key = line.strip(BLANKS).lower()
        if len(key) < min_length or (len(key) < 4 * min_length and len(key.decode("utf-8", "replace")) < min_length):
            key = None
        keys.append(key)
    return keys


def key_hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(key) for key in keys), np.uint64)


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes in a filter segment of ``bits`` bits (a power of two), a row for each probe."""
    step = (hashes >> np.uint64(7)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment (of a power of two), by the top bits of a second mix of the hash."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - 24)).astype(np.int64) & (segments - 1)


class SeenTwice:
    """A once-seen and a twice-seen Bloom filter; both miss nothing."""

    def __init__(self, once_bits: int, twice_bits: int):
        self.once = np.zeros(once_bits, bool)
        self.twice = np.zeros(twice_bits, bool)

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """``hashes`` are distinct; ``again`` marks those that the sender has seen more than once.

        Hashes of one call do not see each other: a pair that shares all bits is no repeat.
        """
        places = probes(hashes, len(self.once))
        known = self.once[places].all(axis=0) | again
        self.once[places.ravel()] = True
        self.twice[probes(hashes[known], len(self.twice)).ravel()] = True


def power_of_two(least: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, least))))


def twice_filter(docs: DataFrame, doc_id: str, text: str, min_length: int, filter_bytes: int) -> tuple[np.ndarray, int]:
    """The packed twice-seen filter over all line keys (a row per segment), and the number of bits of a segment."""
    breaks = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^\n]+", ""))
    lines = (docs.agg(F.sum(breaks + 1)).first()[0]) or 0
    segments = power_of_two(lines / SEGMENT_LINES)
    segments = min(segments, filter_bytes, 1 << 24)
    once_bits = power_of_two(16 * max(lines / segments, 64))
    twice_bits = min(once_bits, max(8, power_of_two(8 * filter_bytes / segments + 1) // 2))
    packed = pa.schema([("segment", pa.int32()), ("hashes", pa.binary()), ("again", pa.binary())])

    def collect(batch: pa.RecordBatch):
        per_doc = {}
        for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            per_doc.setdefault(doc, []).append(np.unique(key_hashes(k for k in line_keys(raw, min_length) if k is not None)))
        # A document that comes in several rows counts once.
        seen = [np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] for parts in per_doc.values()]
        hashes, times = np.unique(np.concatenate(seen), return_counts=True)
        where = segment_of(hashes, segments)
        order = np.argsort(where, kind="stable")
        hashes, times, where = hashes[order], times[order], where[order]
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.array([], int)
        ends = np.r_[starts[1:], len(where)]
        spans = list(zip(starts, ends))
        yield rows(
            packed,
            {
                "segment": [int(where[s]) for s in starts],
                "hashes": [hashes[s:e].tobytes() for s, e in spans],
                "again": [(times[s:e] > 1).tobytes() for s, e in spans],
            },
        )

    def build(batches):
        filters: dict[int, SeenTwice] = {}
        for batch in batches:
            for segment, hashes, again in zip(*(c.to_pylist() for c in batch.columns)):
                if segment not in filters:
                    filters[segment] = SeenTwice(once_bits, twice_bits)
                filters[segment].add(np.frombuffer(hashes, np.uint64), np.frombuffer(again, bool))
        for segment, both in filters.items():
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([segment], pa.int32()), "bits": pa.array([np.packbits(both.twice).tobytes()], pa.binary())}
            )

    sent = arrow_pass(docs.select(doc_id, text), collect, "segment int, hashes binary, again binary")
    # Many small partitions: a task holds the filters of the segments that come to it.
    built = sent.repartition(min(segments, 1 << 17), "segment").mapInArrow(build, "segment int, bits binary")
    whole = np.zeros((segments, twice_bits // 8), np.uint8)
    for row in built.toLocalIterator():
        whole[row.segment] = np.frombuffer(row.bits, np.uint8)
    return whole, twice_bits


def suspected(hashes: np.ndarray, twice: np.ndarray, bits: int) -> np.ndarray:
    places = probes(hashes, bits)
    found = twice[segment_of(hashes, len(twice)), places >> 3] >> (7 - (places & 7)).astype(np.uint8)
    return (found & 1).all(axis=0)


def lost_lines(docs: DataFrame, doc_id: str, text: str, min_length: int, filter_bytes: int) -> DataFrame:
    """(doc, lost): per document the keys of the lines it loses, as one row."""
    spark = docs.sparkSession
    twice, bits = twice_filter(docs, doc_id, text, min_length, filter_bytes)
    shared = spark.sparkContext.broadcast((twice, bits))
    schema = pa.schema([("key", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("docs", pa.list_(pa.int64()))])

    def probe(batch: pa.RecordBatch):
        filter_bits, size = shared.value
        holders: dict[bytes, set] = {}
        for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            keys = list({k for k in line_keys(raw, min_length) if k is not None})
            if keys and doc is not None:
                marked = suspected(key_hashes(keys), filter_bits, size)
                for key in (keys[i] for i in np.flatnonzero(marked)):
                    holders.setdefault(key, set()).add(doc)
        docs_of = [sorted(d) for d in holders.values()]
        yield rows(
            schema,
            {"key": list(holders), "least": [d[0] for d in docs_of], "most": [d[-1] for d in docs_of], "docs": docs_of},
        )

    found = arrow_pass(
        docs.select(F.col(doc_id).cast("long"), text), probe, "key binary, least long, most long, docs array<long>"
    )
    # Stored, since it is read twice: for the keepers, and for the documents that lose.
    found = stored(found, "line_holders", "zstd")
    # One row per key and batch: a line that a third of the documents holds is no hot key here.
    keeper = found.groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most")
    lost = (
        found.join(keeper.select("key", F.col("least").alias("keeper")), "key")
        .select("key", "keeper", F.explode("docs").alias("doc"))
        .where("doc != keeper")
    )
    return lost.groupBy("doc").agg(F.collect_list("key").alias("lost"))


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 10, filter_bytes: int = 1 << 25
) -> DataFrame:
    """``docs`` with the kept text in place of ``text``, and the columns n_lines and n_dropped.

    A text is split at line feeds. A line's key is the line without white space at both ends and
    with A-Z in lower case. Keys of at least ``min_length`` code points that at least two
    documents hold lose all their lines, except in the document of the smallest id.

    * A null or empty text is one empty line: n_lines 1, n_dropped 0, kept text empty.
    * A document whose id is null keeps all its lines and is no holder of any.
    * Rows that repeat a document id are one document: its lines stay in each of the rows, or go from each.
    * Ids are whole numbers; another type raises ValueError. Texts of any length are split whole.
    * Columns named n_lines or n_dropped are replaced; other columns stay as they are.
    * An empty table gives an empty table.
    """
    kind = whole_numbers(docs, doc_id)
    rest = [c for c in docs.columns if c not in (doc_id, text, "n_lines", "n_dropped")]
    columns = [F.col(f"`{c}`") for c in rest]
    lost = lost_lines(docs, doc_id, text, min_length, filter_bytes)
    schema = pa.schema([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def rebuild(batch: pa.RecordBatch):
        kept, before, gone = [], [], []
        for raw, drop in zip(utf8(batch.column("text")), batch.column("lost").to_pylist()):
            lines = raw.split(b"\n")
            before.append(len(lines))
            if drop:
                drop = set(drop)
                lines = [s for s, key in zip(lines, line_keys(raw, min_length)) if key not in drop]
                raw = b"\n".join(lines)
            kept.append(raw)
            gone.append(before[-1] - len(lines))
        done = rows(schema, {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": before, "n_dropped": gone})
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("rest"), *done.columns], names=["doc", "rest", "text", "n_lines", "n_dropped"]
        )

    whole = docs.select(
        F.col(doc_id).alias("doc"), F.struct(F.lit(True).alias(marker(docs)), *columns).alias("rest"), F.col(text).alias("text")
    ).join(lost.select(F.col("doc").cast(kind), "lost"), "doc", "left")
    shape = whole.schema["rest"].dataType.simpleString()
    out = arrow_pass(whole, rebuild, f"doc {kind}, rest {shape}, text string, n_lines long, n_dropped long")
    return out.select(
        F.col("doc").alias(doc_id), F.col("text").alias(text), *[F.col(f"rest.`{c}`") for c in rest], "n_lines", "n_dropped"
    )
