"""Removal of long repeated byte strings, by longest-previous-factor arrays.

No task sees the whole corpus, so strings that could be equal are first brought together:

1. Every window of ``length`` bytes has an anchor, its least-hashed gram (the leftmost of equals), which depends
   on the window's bytes alone. Consecutive windows with one anchor are a stretch. It is cut in two
   at a fixed distance from the anchor, so that all windows of a half share more than half of their bytes;
   the hash of these shared bytes is the key of the half. Equal windows always have equal keys.
2. Halves whose key is found once repeat nothing. Halves found with equal key and content more than once are
   repeated as a whole; one of each stands for them from here on. Both are plain aggregates, so copies in
   any number meet as counts.
3. Where a key has halves of different content, the suffixes of their texts are put in order of their first ``length`` bytes,
   equal ones in text order, with the lengths of common prefixes. The nearest suffix of smaller place before and after
   each one gives its longest previous factor, those of larger place its longest following factor. A window is repeated
   if either is as long as the window.

A key with more than ``GROUP`` different halves is not brought together: its windows are counted by their hash.

Passages of so many words that another text holds too are told beside that, if asked for, whatever their bytes. Runs of windows of
words that share an anchor are cut and go through steps 1 and 2 with the halves of bytes; where a key has halves of different content, their windows
are counted by two hashes. Keys of bytes are even, those of words odd.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.anchors import MULTIPLIER, grams, least_places
from tablepact.llm.passages import pieces, shared_windows, stretches, windows_of
from tablepact.llm.shared import arrow_pass, count_of, marker, rows, stored, utf8

#: Bytes of the grams among which a window has its anchor.
GRAM = 32

#: Bytes of text that are hashed, or sorted, at a time.
SHARD = 1 << 20

#: Different halves of a key that one task sorts.
GROUP = 4096

#: Very frequent keys are looked for in one of so many documents.
SAMPLE = 32

#: Groups of more than so many rows, and of more than one in so many, do not meet in one task: there are at most so many.
HOT = 1024


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes (a power of two) from each place on; the last places are left out."""
    with np.errstate(over="ignore"):
        return grams((text.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER), GRAM)


def shards(texts: list[bytes], length: int):
    """Lists of (document, start in it, bytes), with all windows of all documents, about ``SHARD`` bytes each."""
    held, size = [], 0
    for doc, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, SHARD):
            part = text[start : start + SHARD + length - 1]
            held.append((doc, start, part))
            size += len(part)
            if size >= SHARD:
                yield held
                held, size = [], 0
    if held:
        yield held


def halves(shard: list[tuple[int, int, bytes]], length: int):
    """(document, first window, windows - 1, key, content hash) of all halves of stretches."""
    whole = b"".join(part for _, _, part in shard)
    sizes = np.array([len(part) for _, _, part in shard])
    begins = np.cumsum(sizes) - sizes
    anchor = least_places(gram_hashes(np.frombuffer(whole, np.uint8)), length - GRAM + 1)
    piece = np.repeat(np.arange(len(shard)), sizes)[: len(anchor)]
    place = np.arange(len(anchor))
    valid = place - begins[piece] <= sizes[piece] - length
    places = place[valid]
    own, at = anchor[valid], piece[valid]
    fresh = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1])])
    ends = np.r_[fresh[1:], len(places)] - 1
    reach = (length - GRAM) // 2
    shared = length - reach
    view = memoryview(whole)
    for first, last, a, p in zip(places[fresh].tolist(), places[ends].tolist(), own[fresh].tolist(), at[fresh].tolist()):
        doc, start, _ = shard[p]
        shift = start - int(begins[p])
        # Windows that begin at least ``reach`` before the anchor hold the bytes around it, the others those after it.
        for side, x, y, c in ((0, first, min(last, a - reach), a - reach), (1, max(first, a - reach + 1), last, a)):
            if x <= y:
                key = xxhash.xxh3_64_intdigest(view[c : c + shared], side)
                content = xxhash.xxh3_64_intdigest(view[x : y + length], 7)
                yield doc, x + shift, y - x, key, content


def repeated_windows(contents: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each content, which of its windows occur before in the list (or in it), and which occur after."""
    sizes = np.array([len(c) for c in contents])
    begins = np.cumsum(sizes) - sizes
    windows = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begins, sizes)])
    order, lcp = suffix_order(b"".join(contents), windows, length)
    cuts = np.cumsum(sizes - length + 1)[:-1]
    found = []
    for factors in (longest_factors(order, lcp), longest_factors(-order, lcp)):
        marked = np.zeros(len(windows), bool)
        marked[np.searchsorted(windows, order)] = factors >= length
        found.append(np.split(marked, cuts))
    return found[0], found[1]


def suffix_order(text: bytes, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``places`` in the order of the suffixes that begin there, by their first ``length`` bytes and then by place, and the number of
    bytes each shares with the one before, at most ``length``. Every place has so many bytes."""
    bytes_ = np.frombuffer(text + bytes(8), np.uint8)
    n, width = len(text), 8
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(bytes_, (n, 8), (1, 1))).view(">u8").ravel().astype(np.uint64)
    # Ranks by the first ``width`` bytes, doubled; those past the end of a content are never asked for.
    ranks = [(8, np.unique(words, return_inverse=True)[1].astype(np.int32))] if length >= 8 else []
    while 2 * width <= length:
        rank = ranks[-1][1]
        ranks.append((2 * width, _joined_rank(rank[: n - width], rank[width:], n).astype(np.int32)))
        n, width = n - width, 2 * width
    if ranks:
        keys = [ranks[-1][1][places + length - width], ranks[-1][1][places]]
    else:
        keys = [bytes_[places + i] for i in reversed(range(length))]
    order = places[np.lexsort((places, *keys))]
    lcp = np.zeros(len(order), np.int32)
    if len(order) < 2:
        return order, lcp
    one, two, common = order[:-1], order[1:], np.zeros(len(order) - 1, np.int32)
    for width, rank in reversed(ranks):
        fits = np.flatnonzero(common + width <= length)
        common[fits] += width * (rank[(one + common)[fits]] == rank[(two + common)[fits]])
    open_ = np.arange(len(common))
    for _ in range(min(8, length)):
        open_ = open_[common[open_] < length]
        open_ = open_[bytes_[one[open_] + common[open_]] == bytes_[two[open_] + common[open_]]]
        common[open_] += 1
    lcp[1:] = common
    return order, lcp


def longest_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix in ``order``: what it shares with the suffix of smaller place that shares most.

    That is the nearest of smaller place before it in suffix order, or after it. Given places in reverse, the longest following factors.
    """
    back = np.r_[lcp[:0], 0, lcp[:0:-1]] if len(lcp) else lcp
    return np.maximum(_to_smaller(order, lcp), _to_smaller(order[::-1], back)[::-1])


def _to_smaller(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each entry the least ``lcp`` on the way to the nearest smaller one before it; 0 if there is none.

    By halving steps over tables of minima of 1, 2, 4 ... entries, without a loop over entries.
    """
    n = len(order)
    least, common = [order.astype(np.int64)], [lcp]
    while 2 ** len(least) <= n:
        step = 2 ** (len(least) - 1)
        # Entry i stands for the run of 2 * step entries that ends with it.
        least.append(np.r_[least[-1][:step], np.minimum(least[-1][step:], least[-1][:-step])])
        common.append(np.r_[common[-1][:step], np.minimum(common[-1][step:], common[-1][:-step])])
    end, shared = np.arange(n), np.full(n, np.iinfo(np.int32).max)
    for level in reversed(range(len(least))):
        # Before entry ``end`` all are larger, up to the entry itself; a whole run of larger ones is stepped over.
        able = np.flatnonzero(end >= 2**level)
        able = able[least[level][end[able] - 1] > least[0][able]]
        shared[able] = np.minimum(shared[able], common[level][end[able]])
        end[able] -= 2**level
    return np.where(end > 0, np.minimum(shared, lcp[end]), 0)


def _joined_rank(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    return np.unique(first.astype(np.int64) * (n + 1) + second, return_inverse=True)[1]


def spans_of(marked: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """The bytes that marked windows cover, as (start, end)."""
    edges = np.flatnonzero(np.diff(np.r_[0, marked.astype(np.int8), 0]))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(edges[::2], edges[1::2])]


SPAN = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("passage", pa.bool_())])
PLACE = ("doc", "x", "more")


def _of_words() -> Column:
    """Whether a half is one of words."""
    return F.col("key").bitwiseAND(F.lit(1)) == 1


def _index(docs: DataFrame, length: int, passage: int | None) -> DataFrame:
    """Halves of stretches of bytes, and of windows of ``passage`` words; each has ``length`` + more bytes."""
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("x", pa.int32()), ("more", pa.int32())])

    def batch_of(ids, doc, x, more, key, content):
        return rows(schema, {"key": key.view(np.int64), "content": content.view(np.int64), "doc": ids[doc], "x": x, "more": more})

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column("doc").to_numpy(), utf8(batch.column("text"))
        for shard in shards(texts, length):
            found = list(halves(shard, length))
            if found:
                doc, x, more, key, content = (np.array(c, t) for c, t in zip(zip(*found), (np.int64, np.int32, np.int32, np.uint64, np.uint64)))
                yield batch_of(ids, doc, x, more, key & ~np.uint64(1), content)
        for shard in pieces(texts, passage, SHARD) if passage else ():
            found = stretches(shard, passage)
            if found:
                doc, x, size, key, content = found
                yield batch_of(ids, doc, x.astype(np.int32), (size - length).astype(np.int32), key | np.uint64(1), content)

    return arrow_pass(docs.select("doc", "text"), run, "key long, content long, doc long, x int, more int")


def _meet(rows_: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows_`` (``total`` of them) with the columns of ``groups``, which tell in ``times`` how many rows they have.

    Groups with a thousandth of the rows or more are at most HOT: they are sent to the rows, whose tasks stay as they are.
    """
    often = F.col("times") > max(HOT, total // HOT)
    hot = groups.where(often).drop("times")
    rest = rows_.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows_.join(F.broadcast(hot), on).unionByName(rest.join(groups.where(~often).drop("times"), on))


def _texts(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of chosen halves."""
    fields = ("key", *PLACE, "last", "different")
    by_doc = chosen.groupBy("doc").agg(F.collect_list(F.struct("key", "x", "more", "last", "different")).alias("halves"))
    # Copies of a text have one entry here: any of them gives the bytes.
    schema = pa.schema(
        [("key", pa.int64()), ("doc", pa.int64()), ("x", pa.int32()), ("more", pa.int32()), ("last", pa.int64()), ("different", pa.int64()), ("bytes", pa.binary())]
    )

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                out = {n: [] for n in schema.names}
                for doc, text, chosen_here in zip(batch.column("doc").to_pylist(), utf8(batch.column("text")), batch.column("halves").to_pylist()):
                    for h in chosen_here:
                        h["doc"], h["bytes"] = doc, text[h["x"] : h["x"] + h["more"] + length]
                        for name in schema.names:
                            out[name].append(h[name])
                yield rows(schema, out)

    shape = "key long, doc long, x int, more int, last long, different long, bytes binary"
    return docs.join(by_doc, "doc").select("doc", "text", "halves").mapInArrow(run, shape).select(*fields, "bytes")


def _sorted_spans(halves_: DataFrame, length: int, keep_first: bool, passage: int | None) -> DataFrame:
    """Spans from keys whose halves one task sorts."""

    def found(together: list[dict]) -> pa.RecordBatch:
        out, held = [], [h for h in together if not h["key"] & 1]
        if held:
            previous, following = repeated_windows([h["bytes"] for h in held], length)
            for h, before, after in zip(held, previous, following):
                marked = before if keep_first else before | after
                out += [(h["doc"], s, e, False) for s, e in spans_of(marked, h["x"], length)]
        held = [h for h in together if h["key"] & 1]
        if held:
            told = shared_windows([h["bytes"] for h in held], [h["doc"] for h in held], [h["last"] for h in held], passage)
            out += [(held[i]["doc"], held[i]["x"] + s, held[i]["x"] + e, True) for i, s, e in told]
        return rows(SPAN, {n: [o[i] for o in out] for i, n in enumerate(SPAN.names)})

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            for h in batch.to_pylist():
                if h["key"] != key and size >= SHARD:
                    yield found(held)
                    held, size = [], 0
                key = h["key"]
                held.append(h)
                size += len(h["bytes"])
        if held:
            yield found(held)

    ordered = halves_.repartition("key").sortWithinPartitions("key", "doc", "x")
    return ordered.mapInArrow(run, "doc long, start int, end int, passage boolean")


def _counted_spans(halves_: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans from keys with very many different halves: windows that are equal by two hashes."""
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("doc", pa.int64()), ("start", pa.int32())])

    def run(batch: pa.RecordBatch):
        for h in batch.to_pylist():
            view, n = memoryview(h["bytes"]), h["more"] + 1
            both = [[np.int64(np.uint64(xxhash.xxh3_64_intdigest(view[i : i + length], s)).view(np.int64)) for i in range(n)] for s in (1, 2)]
            yield rows(schema, {"one": both[0], "two": both[1], "doc": [h["doc"]] * n, "start": [h["x"] + i for i in range(n)]})

    windows = arrow_pass(halves_.select("doc", "x", "more", "bytes"), run, "one long, two long, doc long, start int")
    first = F.min(F.struct("doc", "start")).alias("first")
    repeated = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    kept = windows.join(repeated, ["one", "two"])
    if keep_first:
        kept = kept.where(F.struct("doc", "start") != F.col("first"))
    return kept.select("doc", "start", (F.col("start") + length).alias("end"), F.lit(False).alias("passage"))


def _passage_spans(halves_: DataFrame, passage: int) -> DataFrame:
    """Spans of passages from keys with very many different halves: windows that are equal by two hashes."""
    fields = [("one", pa.int64()), ("two", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
    schema = pa.schema(fields)

    def run(batch: pa.RecordBatch):
        at, start, end, one, two = windows_of(batch.column("bytes").to_pylist(), passage)
        doc, last, x = (batch.column(n).to_numpy()[at] for n in ("doc", "last", "x"))
        out = {"one": one.view(np.int64), "two": two.view(np.int64), "doc": doc, "last": last}
        yield rows(schema, out | {"start": (x + start).astype(np.int32), "end": (x + end).astype(np.int32)})

    shape = "one long, two long, doc long, last long, start int, end int"
    windows = stored(arrow_pass(halves_.select("doc", "last", "x", "bytes"), run, shape), "windows")
    groups = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times"), F.min("doc").alias("least"), F.max("last").alias("most"))
    shared = stored(groups.where("least < most").select("one", "two", "times"), "shared")
    return _meet(windows, shared, ["one", "two"], count_of(windows)).select("doc", "start", "end", F.lit(True).alias("passage"))


def _hot(docs: DataFrame, length: int, passage: int | None) -> DataFrame:
    """Keys found very often in every ``SAMPLE``-th document: the rows of others need no more than a task."""
    seen = stored(_index(docs.where(F.col("doc") % SAMPLE == 0), length, passage).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "seen")
    often = max(8, (seen.agg(F.sum("n")).first()[0] or 0) // HOT)
    return seen.where(F.col("n") > often).select("key", F.lit(True).alias("hot"))


def repeated_spans(
    docs: DataFrame, length: int = 400, keep_first: bool = False, group: int = GROUP, passage: int | None = None
) -> DataFrame:
    """(doc, start, end, passage): stretches of bytes of windows that occur elsewhere; they may overlap.

    ``docs`` has the columns doc (a number of its own for every row) and text. With ``keep_first`` the window of the smallest
    (doc, start) among equals is not reported. Where passage is true, these are windows of ``passage`` words that occur in another document,
    all of them.
    """
    # One shuffle brings a key's halves together; what is found once, or of words in one document alone, goes no further. Those of
    # keys that are found often in a sample are dealt over many tasks, and all go on.
    index = _index(docs, length, passage).join(F.broadcast(_hot(docs, length, passage)), "key", "left")
    dealt = index.withColumn("part", F.when(F.col("hot"), F.xxhash64("doc", "x") % 256).otherwise(F.lit(0).cast("long")))
    own = Window.partitionBy("key", "part")
    met = dealt.withColumns({"n": F.count(F.lit(1)).over(own), "least": F.min("doc").over(own), "most": F.max("doc").over(own)})
    apart = F.when(_of_words(), F.col("least") < F.col("most")).otherwise(F.col("n") > 1)
    near = stored(met.where(F.coalesce(F.col("hot"), apart)).select("key", "content", *PLACE), "near")
    contents = stored(
        near.groupBy("key", "content").agg(
            F.count(F.lit(1)).alias("times"), F.min(F.struct(*PLACE)).alias("place"), F.max("doc").alias("last")
        ),
        "contents",
    )
    of_one = F.col("place.doc") == F.col("last")
    copies = contents.where(F.when(_of_words(), ~of_one).otherwise(F.col("times") > 1)).drop("last")
    total = count_of(near)
    copied = _meet(near, copies, ["key", "content"], total)
    if keep_first:
        copied = copied.where(_of_words() | (F.struct(*PLACE) != F.col("place")))
    end = F.col("x") + F.col("more") + length
    spans = [copied.select("doc", F.col("x").alias("start"), end.alias("end"), _of_words().alias("passage"))]
    places = contents.select("key", "place.*", "last")
    if passage:
        # One of each content stands for all, but not for further runs of the same document that is the only one to hold them.
        within = contents.where(_of_words() & of_one & (F.col("times") > 1)).select("key", "content", "place", "last")
        further = near.where(_of_words()).join(within, ["key", "content"]).where(F.struct(*PLACE) != F.col("place"))
        places = places.unionByName(stored(further.select(*places.columns), "further"))
    different = F.count(F.lit(1))
    kinds = stored(contents.groupBy("key").agg(different.alias("different"), different.alias("times")).where("different > 1"), "kinds")
    texts = stored(_texts(docs, _meet(places, kinds, ["key"], total), length), "halves")
    spans.append(_sorted_spans(texts.where(F.col("different") <= group), length, keep_first, passage))
    large = texts.where(F.col("different") > group)
    if not large.isEmpty():
        spans.append(_counted_spans(large.where(~_of_words()), length, keep_first))
        if passage:
            spans.append(_passage_spans(large.where(_of_words()), passage))
    return reduce(DataFrame.unionAll, spans)


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans that overlap as one."""
    out = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = 400, keep_first: bool = False, group: int = GROUP, passage: int | None = None
) -> DataFrame:
    """``docs`` with kept (the remaining bytes), n_bytes, n_removed and n_spans in place of ``text``.

    Texts are UTF-8. A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else, in the same text
    or another; matches never cross texts, and are judged on the input. With ``keep_first``, strings stay at the
    first place they are found at. n_spans counts the maximal removed runs.

    With ``passage``, the columns n_passages and n_passage_words tell of passages of so many words or more that the text of another row holds too,
    with whatever space between the words: how many there are, overlapping ones as one, and how many words they cover. They are told only, by
    words and not by ``length``; nothing is removed for them.

    * Null and empty texts, and those shorter than ``length``, lose nothing.
    * Repeated rows are copies of each other like any other texts; a null id is no special case.
    * Columns of those names are replaced; others stay as they are. An empty table gives an empty table.
    """
    made = ("kept", "n_bytes", "n_removed", "n_spans", *(("n_passages", "n_passage_words") if passage else ()))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in made]
    numbered = stored(
        docs.select(F.monotonically_increasing_id().alias("doc"), F.struct(F.lit(True).alias(marker(docs)), *rest).alias("rest"), F.col(text).alias("text")),
        "texts",
        "zstd",
    )
    span = F.struct("start", "end")
    spans = (
        repeated_spans(numbered, length, keep_first, group, passage)
        .groupBy("doc")
        .agg(F.collect_set(F.when(~F.col("passage"), span)).alias("spans"), F.collect_set(F.when(F.col("passage"), span)).alias("passages"))
    )
    shape = numbered.schema["rest"].dataType.simpleString()
    schema = pa.schema([("kept", pa.binary()), *((n, pa.int64()) for n in made[1:])])

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                out = {n: [] for n in made}
                for raw, own, told in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), batch.column("passages").to_pylist()):
                    parts, at, removed, runs = [], 0, 0, 0
                    for s in sorted((s["start"], s["end"]) for s in own or ()):
                        if s[0] > at or not runs:
                            runs += 1
                            parts.append(raw[at : s[0]])
                        removed += max(0, s[1] - max(at, s[0]))
                        at = max(at, s[1])
                    parts.append(raw[at:])
                    passages = _merged(told)
                    words = sum(len(raw[start:end].split()) for start, end in passages)
                    for name, value in zip(made, (b"".join(parts), len(raw), removed, runs, len(passages), words)):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([batch.column("rest"), *rows(schema, out).columns], names=["rest", *made])

    whole = numbered.join(spans, "doc", "left").select("rest", "text", "spans", "passages")
    done = whole.mapInArrow(run, f"rest {shape}, kept binary, {', '.join(f'{n} long' for n in made[1:])}")
    names = [c for c in docs.columns if c != text and c not in made]
    return done.select(*[F.col(f"rest.`{c}`") for c in names], *made)
