"""Packing documents into sequences of a fixed window, by non-negative least squares.

A document's tokens are cut into full windows, each a sequence of its own, and a tail. The histogram
of tail lengths (one count per length up to the window) is all that the driver sees. Shallow
combinations of lengths that fill the window are enumerated, their repeat counts solved by
non-negative least squares against the histogram and rounded down to what is there; the tails left
over are packed greedily, longest first, end to end, and cut where a sequence is full. What the
last sequence lacks is avoided by cutting it at powers of two, which need no padding.

A tail finds its place by its rank among the tails of its length. Ranks are counted within a task
while the tokens are stored, and made global by the counts of the tasks before, so neither a
frequent length nor the tokens meet in one task.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.shared import rows, stored

#: Sequence ids of full windows begin here, those of one task every 2^36.
FULL_WINDOWS = 1 << 62

#: Words and parts of words whose ids a Python worker keeps, and the longest that is kept.
KEPT_WORDS, KEPT_PIECES, KEPT_LENGTH = 1 << 18, 1 << 19, 64


#: Lower-case words of letters with marks behind them: the tokenizer parts them there and nowhere else.
PLAIN = re.compile(r"([a-z\u00DF-\u00F6\u00F8-\u00FF]*)([!#-&(-/:-@\[-`{-~]*)")


class Kept(dict):
    """Values by key, made where missing; emptied when there are ``most``."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """The ids that the tokenizer gives a text, as little-endian 32-bit numbers; made word by word, and kept by word.

    For a tokenizer that lower-cases and drops white space, as ``word_bpe_49k.json`` does: no token spans words.
    Texts with marks of special tokens, or with separators that count as white space for one side
    only, are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = Kept(self.word, KEPT_WORDS), Kept(self.piece, KEPT_PIECES)

    def whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        """Ids of letters, or of marks, that no rule parts further."""
        spelled = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)] if not piece.isascii() else [piece]
        return as_bytes([token.id for part in spelled for token in self.tokenizer.model.tokenize(part)])

    def word(self, word: str) -> bytes:
        if plain := PLAIN.fullmatch(word):
            letters, marks = plain.groups()
            return self.pieces[letters] + self.pieces[marks] if marks else self.pieces[letters]
        return self.whole(word)

    def encode(self, text: str) -> bytes:
        """Latin texts are lower-cased here, which they are alike in any version of Unicode, and need no composing."""
        if any(mark in text for mark in ("<|", "\x1c", "\x1d", "\x1e", "\x1f")):
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.words.__getitem__, text.split()))
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def kept_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, so that later tasks find the words of earlier ones."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def tokenize(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Tokens, and what places them: (doc_id, ids, part, fulls, tail, rank); a row per document.

    ``fulls`` counts the full windows and ``rank`` the tails of the same length before it in the task.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    placed = pa.schema(
        [("ids", pa.binary()), ("part", pa.int32()), ("fulls", pa.int64()), ("tail", pa.int32()), ("rank", pa.int64())]
    )

    def run(batches):
        encoder, part = kept_encoder(tokenizer), TaskContext.get().partitionId()
        fulls, tails = 0, np.zeros(window + 1, np.int64)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                out = {name: [] for name in placed.names}
                for body in batch.column(1).to_pylist():
                    ids = encoder.encode(body or "") + as_bytes([end_id])
                    size = len(ids) // 4
                    tail = (size - 1) % window + 1
                    values = (ids, part, fulls, tail, tails[tail])
                    for name, value in zip(placed.names, values):
                        out[name].append(value)
                    fulls += (size - tail) // window
                    tails[tail] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *rows(placed, out).columns], names=["doc_id", *placed.names]
                )

    shape = f"doc_id {kind}, ids binary, part int, fulls long, tail int, rank long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, shape)


def combinations(window: int, step: int) -> np.ndarray:
    """Up to three lengths that fill the window, the third a multiple of ``step``; unused places are 0."""
    first = np.arange(1, window)
    pairs = np.stack([first, window - first, np.zeros_like(first)], axis=1)
    a, b = (g.ravel() for g in np.meshgrid(first, np.arange(step, window, step)))
    triples = np.stack([a, b, window - a - b], axis=1)[a + b < window]
    whole = np.array([[window, 0, 0]])
    return np.unique(np.sort(np.concatenate([whole, pairs, triples]), axis=1)[:, ::-1], axis=0)


def repeat_counts(parts: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: how often each combination is used, so that lengths sum to the histogram.

    Every round takes the step of a separable bound on the squared error, which never raises it.
    """
    used = parts > 0

    def lengths(x):
        summed = np.bincount(parts.ravel(), weights=np.repeat(x, parts.shape[1]), minlength=len(histogram))
        summed[0] = 0
        return summed

    def columns(r):
        return np.where(used, r[parts], 0).sum(axis=1)

    bound = columns(lengths(np.ones(len(parts))))
    x = np.zeros(len(parts))
    for _ in range(rounds):
        x = np.maximum(0, x + columns(histogram - lengths(x)) / bound)
    return x


def rounded(parts: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts near ``x``, largest first, never more than the tails that are there."""
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(parts), np.int64)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        needed = [(length, len(list(same))) for length, same in groupby(parts[j][parts[j] > 0].tolist())]
        counts[j] = min([round(x[j]), *(left[length] // n for length, n in needed)])
        for length, n in needed:
            left[length] -= counts[j] * n
    return counts


@dataclass(frozen=True)
class Layout:
    """Where the tails go: ranges of ranks of a length take a place of a combination, the rest follow end to end."""

    window: int
    first: np.ndarray  # length << 40 | first rank of the range
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    combined: np.ndarray  # by length: tails that a combination takes
    stream: np.ndarray  # by length: where the other tails begin in the stream
    stream_sequence: int
    stream_size: int

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the parts of the tail of this rank."""
        if rank < self.combined[length]:
            slot = int(np.searchsorted(self.first, (length << 40) | rank, side="right")) - 1
            within = rank - int(self.first[slot] & ((1 << 40) - 1))
            return [(0, length, int(self.sequence[slot]) + within, int(self.offset[slot]))]
        at = int(self.stream[length]) + (rank - int(self.combined[length])) * length
        out, done = [], 0
        while done < length:
            sequence, offset, room = self.in_stream(at + done)
            size = min(room, length - done)
            out.append((done, size, sequence, offset))
            done += size
        return out

    def in_stream(self, at: int) -> tuple[int, int, int]:
        """The sequence at a place of the stream, the offset in it, and the room up to its end."""
        number, offset = divmod(at, self.window)
        whole, rest = divmod(self.stream_size, self.window)
        sequence = self.stream_sequence + number
        if number < whole:
            return sequence, offset, self.window - offset
        for bit in reversed(range(self.window.bit_length())):
            size = 1 << bit
            if rest & size:
                if offset < size:
                    return sequence, offset, size - offset
                offset, sequence = offset - size, sequence + 1
        raise ValueError(f"{at} is not in the stream")


def lay_out(histogram: np.ndarray, window: int, step: int) -> Layout:
    """The layout for a histogram of tail lengths (index 0 unused)."""
    parts = combinations(window, step)
    counts = rounded(parts, repeat_counts(parts, histogram.astype(float)), histogram)
    base = np.cumsum(counts) - counts
    ahead = np.cumsum(parts, axis=1) - parts
    slots = [
        (int(parts[j, k]), int(counts[j]), int(base[j]), int(ahead[j, k]))
        for j in np.flatnonzero(counts)
        for k in range(parts.shape[1])
        if parts[j, k]
    ]
    slots.sort(key=lambda s: s[0])
    combined, first = np.zeros(window + 1, np.int64), []
    for length, count, _, _ in slots:
        first.append((length << 40) | int(combined[length]))
        combined[length] += count
    left = (histogram - combined) * np.arange(window + 1)
    stream = np.zeros(window + 1, np.int64)
    stream[::-1] = np.cumsum(left[::-1]) - left[::-1]
    column = lambda i: np.array([s[i] for s in slots], np.int64)
    return Layout(
        window, np.array(first, np.int64), column(1), column(2), column(3), combined, stream, int(counts.sum()), int(left.sum())
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    window: int = 2048,
    step: int = 64,
) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document is the ids of its text and ``end_id``. ``tokenizer`` is the path of the file on the executors;
    it must be one that drops white space.

    * Null and empty texts are ``end_id`` alone.
    * Rows that repeat an id are documents of their own; a null id stays null.
    * Only the two named columns are read. An empty table gives an empty table.
    """
    tokens = stored(tokenize(docs, doc_id, text, tokenizer, end_id, window), "tokens")
    tails = tokens.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tails.select("part", "tail", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    histogram = np.zeros(window + 1, np.int64)
    for row in tails.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        histogram[row.tail] = row.n
    layout = lay_out(histogram, window, step)
    placed = tokens.join(offsets, ["part", "tail"]).select(
        "doc_id", "ids", "part", "fulls", "tail", (F.col("rank") + F.col("ahead")).alias("rank")
    )
    kind = tokens.schema["doc_id"].dataType.simpleString()
    names = ("start", "length", "doc_tokens", "sequence_id", "offset")
    fields = pa.schema([("ids", pa.binary()), *((n, pa.int64()) for n in names)])

    def cut(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                owner, out = [], {n: [] for n in fields.names}
                columns = [batch.column(n).to_pylist() for n in ("ids", "part", "fulls", "tail", "rank")]
                for i, (ids, part, fulls, tail, rank) in enumerate(zip(*columns)):
                    size = len(ids) // 4
                    first = FULL_WINDOWS + (part << 36) + fulls
                    parts = [(n * window, window, first + n, 0) for n in range((size - tail) // window)]
                    parts += [(size - tail + s, n, sequence, at) for s, n, sequence, at in layout.pieces(tail, rank)]
                    for start, length, sequence, at in parts:
                        owner.append(i)
                        values = (ids[4 * start : 4 * (start + length)], start, length, size, sequence, at)
                        for name, value in zip(fields.names, values):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner)), *rows(fields, out).columns], names=["doc_id", *fields.names]
                )

    shape = f"doc_id {kind}, ids binary, {', '.join(f'{n} long' for n in names)}"
    return placed.mapInArrow(cut, shape)
