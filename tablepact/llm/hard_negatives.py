"""Hard negatives for contrastive training, by Kronecker-packed inner products.

Components become integers. Those of several candidates are biased to be non-negative and laid side by side in the
fields of one wide integer, so that one multiplication by an anchor's component serves all of them. The sum over
components holds every candidate's score in its own field, whatever carries and signs did on the way, since
the sum is taken modulo the integer's width and each anchor's correction moves all scores into 0 .. 2 * bound.
The bound is that of Cauchy and Schwarz over the longest anchor and the longest candidate; it decides how many fields
64 bits hold. Where they hold none, Python's integers of any width do the same.

Anchors are dealt to blocks, candidates to parts; a task holds one block and streams one part past it, and keeps of each
anchor its best few. The first pass finds the positives, whose scores are the windows in which the second
pass looks for negatives. The best of all parts are then chosen by a window over the few that parts have kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.shared import rows, stored, whole_numbers

#: Anchors that a task holds.
BLOCK = 4096

#: Candidates that a task streams past a block.
PART = 1 << 16

#: Scores that a task looks at together.
SCORES = 1 << 18

#: Fields of a packed integer that is wider than 64 bits.
WIDE_FIELDS = 8

#: Stands for no score; scores stay above it.
NONE = np.iinfo(np.int64).min

FOUND = "anchor long, place int, score long, vec_id long, row long"


def units(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, in double precision; short vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), size))
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), place] = np.floor(scale * values)
    return out


class Packing:
    """How many candidates share an integer, and the arithmetic on it."""

    def __init__(self, bound: int):
        self.bound = bound
        self.width = (2 * bound).bit_length()
        self.fields = 64 // self.width or WIDE_FIELDS
        self.wide = self.width > 64
        self.kind = object if self.wide else np.uint64

    def integers(self, values: np.ndarray) -> np.ndarray:
        """Whole doubles as integers of the packed kind; negative ones modulo 2^64."""
        if self.wide:
            return np.array([[int(v) for v in row] for row in values], object).reshape(values.shape)
        return values.astype(np.int64).view(np.uint64)

    def pack(self, candidates: np.ndarray) -> tuple[np.ndarray, int]:
        """(components x packed candidates, bias)."""
        low = candidates.min(initial=0.0)
        biased = self.integers(candidates - low)
        whole = np.zeros((-(-len(biased) // self.fields) * self.fields, biased.shape[1]), self.kind)
        whole[: len(biased)] = biased
        packed = whole[0 :: self.fields].copy()
        for field in range(1, self.fields):
            packed += whole[field :: self.fields] << self.kind_of(self.width * field)
        return packed.T.copy(), -int(low)

    def kind_of(self, value: int):
        return value if self.wide else np.uint64(value % (1 << 64))

    def scores(self, anchors: np.ndarray, packed: np.ndarray, bias: int, count: int) -> np.ndarray:
        """Anchors x candidates, exact."""
        ones = sum(1 << (self.width * field) for field in range(self.fields))
        shift = (self.kind_of(self.bound) - anchors.sum(axis=1) * self.kind_of(bias)) * self.kind_of(ones)
        total = anchors @ packed + shift[:, None]
        out = np.empty((len(anchors), packed.shape[1], self.fields), object if self.wide else np.int64)
        for field in range(self.fields):
            own = (total >> self.kind_of(self.width * field)) & self.kind_of((1 << self.width) - 1)
            out[:, :, field] = own - self.bound if self.wide else own.view(np.int64) - self.bound
        out = out.reshape(len(anchors), -1)[:, :count]
        return out.astype(np.int64)


class Best:
    """The best few rows of every slot: higher scores first, then smaller ids (null last)."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.floor = np.full(slots, NONE)
        self.held = {n: np.empty(0, t) for n, t in (("slot", int), ("score", np.int64), ("vec_id", np.int64), ("known", bool), ("row", np.int64))}

    def add(self, slots: np.ndarray, scores: np.ndarray, vec_id: np.ndarray, known: np.ndarray, row: np.ndarray) -> None:
        """``scores``: slots x candidates, NONE where a candidate doesn't count."""
        alive = np.flatnonzero(scores.max(axis=1, initial=NONE) >= np.maximum(self.floor[slots], NONE + 1))
        if not len(alive):
            return
        slots, scores = slots[alive], scores[alive]
        bar = np.maximum(self.floor[slots], NONE + 1)
        if scores.shape[1] > self.keep:
            bar = np.maximum(bar, np.partition(scores, -self.keep, axis=1)[:, -self.keep])
        slot, candidate = np.nonzero(scores >= bar[:, None])
        new = {"slot": slots[slot], "score": scores[slot, candidate], "vec_id": vec_id[candidate], "known": known[candidate], "row": row[candidate]}
        touched = np.isin(self.held["slot"], slots)
        both = {n: np.concatenate([self.held[n][touched], new[n]]) for n in new}
        order = np.lexsort((both["row"], both["vec_id"], ~both["known"], -both["score"], both["slot"]))
        slot = both["slot"][order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        order, full = order[place < self.keep], order[place == self.keep - 1]
        self.floor[both["slot"][full]] = both["score"][full]
        self.held = {n: np.concatenate([self.held[n][~touched], both[n][order]]) for n in both}


def _search(size: int, scale: int, packing: Packing, keep: int, low: int, high: int):
    """Best candidates of each anchor: of its own label, or in the windows of its positives, of other labels."""
    found = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])

    def window(score: int) -> tuple[int, int]:
        return -(-low * score // 100), high * score // 100

    def search(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [], None
        for batch in group:
            side = batch.column("side").to_numpy()
            anchors = batch.slice(0, int((side == 0).sum()))
            if anchors.num_rows:
                held.append(anchors)
            if anchors.num_rows < batch.num_rows:
                if first is None:
                    if not held:
                        return
                    first = prepare(pa.Table.from_batches(held))
                look(*first, batch.slice(anchors.num_rows))
        if first:
            own, best = first[0], first[-1]
            ids = pa.array(best.held["vec_id"], mask=~best.held["known"])
            yield rows(found, {"anchor": own["row"][own["of"][best.held["slot"]]], "place": own["place"][best.held["slot"]].astype(np.int32), "score": best.held["score"], "vec_id": ids, "row": best.held["row"]})

    def prepare(table: pa.Table):
        codes: dict = {}
        label = np.array([codes.setdefault(v, len(codes)) for v in table.column("label").to_pylist()], int)
        own = {"row": table.column("row").to_numpy(), "label": label}
        windows = table.column("positives").to_pylist()
        if windows and windows[0] is not None:
            spans = [(a, p, *window(s)) for a, w in enumerate(windows) for p, s in enumerate(w)]
        else:
            spans = [(a, 0, 0, 0) for a in range(len(windows))]
        own["of"], own["place"], own["low"], own["high"] = np.array(spans, np.int64).reshape(-1, 4).T
        own["other"] = bool(windows) and windows[0] is not None
        vectors = packing.integers(units(table.column("vector").combine_chunks(), size, scale))
        return own, codes, vectors, Best(len(spans), keep)

    def look(own, codes, vectors, best: Best, batch: pa.RecordBatch) -> None:
        label = np.array([codes.get(v, -1) for v in batch.column("label").to_pylist()], int)
        row = batch.column("row").to_numpy()
        known = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        vec_id = batch.column("vec_id").fill_null(0).to_numpy()
        packed, bias = packing.pack(units(batch.column("vector"), size, scale))
        chunk = max(1, SCORES // batch.num_rows)
        for start in range(0, len(own["of"]), chunk):
            slots = np.arange(start, min(start + chunk, len(own["of"])))
            anchors, of = np.unique(own["of"][slots], return_inverse=True)
            scores = packing.scores(vectors[anchors], packed, bias, batch.num_rows)[of]
            same = own["label"][own["of"][slots], None] == label
            if own["other"]:
                fits = ~same & (scores >= own["low"][slots, None]) & (scores <= own["high"][slots, None])
            else:
                fits = same & (own["row"][own["of"][slots], None] != row)
            best.add(slots, np.where(fits, scores, NONE), vec_id, known, row)

    def run(batches):
        for _, group in _by_group(batches):
            yield from search(group)

    return run


def _by_group(batches):
    """(key, batches of at most 2048 rows) of each run of equal block and part."""

    def pieces():
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("block", "part")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for start, end in zip(starts, np.r_[starts[1:], len(keys)]):
                for at in range(start, end, 2048):
                    yield tuple(keys[start]), batch.slice(at, min(2048, end - at))

    source = pieces()
    piece = next(source, None)
    while piece:
        key, ended = piece[0], []

        def group():
            nonlocal piece
            while piece and piece[0] == key:
                yield piece[1]
                piece = next(source, None)
            ended.append(True)

        own = group()
        yield key, own
        for _ in own:
            pass


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The best of what the parts have kept, numbered from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): up to ``negatives`` rows per anchor and positive.

    Components x count as floor(scale * x); a score is the integer inner product with the anchor, exact. Anchors are the rows
    that fulfil ``anchors``, a condition on the columns of ``vectors``. Positives are an anchor's ``positives`` highest
    scored other rows of its label; negatives the highest scored rows of other labels with a score of
    ``low`` to ``high`` per cent of the positive's. Ties go to the smaller id.

    * Rows with a null label, a null vector, or a null or non-finite component take no part; zero and empty vectors do.
    * Shorter vectors count as filled up with zeros. Labels of any type are compared as text.
    * Ids are whole numbers (another type raises ValueError); a null id comes last among ties, and is returned as null.
    * Repeated rows are rows of their own: an anchor's copy is an other row, and each copy of an anchor has its own result.
    * A positive with a negative score has no negatives; one of zero has those of score zero.
    * Scores are longs: vectors so long that a score might not be one raise ValueError.
    * Only the named columns are read, and those of ``anchors``. An empty table, or no anchor, gives an empty table.
    """
    whole_numbers(vectors, vec_id)
    spark = vectors.sparkSession
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = vectors.where(F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    entries = stored(taken, "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + (scale * x.cast("double")) ** 2 + 2 * F.abs(scale * x.cast("double")) + 1)
    facts = entries.agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if("anchor").alias("anchors"),
        F.max(F.size("vector")).alias("size"),
        F.max(square).alias("longest"),
        F.max(F.when(F.col("anchor"), square)).alias("longest_anchor"),
    ).first()
    size = facts["size"] or 0
    # 1e-9 covers what rounding may have taken from sums of squares.
    bound = int(np.ceil(((facts["longest"] or 0.0) * 1.000000001) ** 0.5 * ((facts["longest_anchor"] or 0.0) * 1.000000001) ** 0.5)) + 1
    if bound > 1 << 62:
        raise ValueError(f"scores up to {bound} do not fit a long")
    packing = Packing(bound)
    blocks = max(1, -(-facts["anchors"] // BLOCK))
    workers = spark.sparkContext.defaultParallelism
    parts = max(1, -(-facts["all"] // PART), min(-(-facts["all"] // 1024), -(-3 * workers // blocks)))

    def searched(side: DataFrame, keep: int) -> DataFrame:
        """What each part keeps of each anchor."""
        windows = side.schema["positives"].dataType.simpleString()
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
        held = side.withColumn("block", block).select("block", every(parts).alias("part"), F.lit(0).alias("side"), "row", "vec_id", "label", "vector", "positives")
        streamed = entries.withColumn("part", part).select(
            every(blocks).alias("block"), "part", F.lit(1).alias("side"), "row", "vec_id", "label", "vector", F.lit(None).cast(windows).alias("positives")
        )
        dealt = held.unionAll(streamed).repartition(min(blocks * parts, 1 << 14), "block", "part").sortWithinPartitions("block", "part", "side")
        return dealt.mapInArrow(_search(size, scale, packing, keep, low, high), FOUND)

    chosen = entries.where("anchor").drop("anchor")
    none = F.lit(None).cast("array<long>").alias("positives")
    positive = stored(_best(searched(chosen.select("*", none), positives), positives), "positives")
    windows = positive.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("own"))
    windowed = chosen.join(windows, chosen["row"] == windows["anchor"]).select("row", "vec_id", "label", "vector", F.col("own.score").alias("positives"))
    negative = _best(searched(windowed, negatives), negatives)
    names = chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    own = positive.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        negative.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(own, ["anchor", "place"])
        .join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
