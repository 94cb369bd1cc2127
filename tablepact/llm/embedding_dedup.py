"""Near-duplicate embeddings: spherical k-means cells, blocked cosines within cells.

Equal vectors are made one entry first. Centres are fitted on a bounded sample; every entry is then at home in its
nearest cell, and visits the other cells whose centre is nearly as near, so pairs across a border
are seen as well. The members of a cell are dealt to blocks of about ``BLOCK`` entries, the visitors too, and each
pair of blocks is one group of bounded size, whatever the size of the cell. A group gives, per entry, how
many vectors it is linked with, and a spanning set of links.

Whether a pair is seen depends on the cells: recall is measured in the tests. No pair below the threshold is
ever linked, and all cosines are taken in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.shared import components, count_of, rows, stored, whole_numbers
from tablepact.llm.simhash import spanning

#: Entries of a block.
BLOCK = 1024


def comparable(vector: Column) -> Column:
    """Not null, no component null or non-finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a list column, filled up with zeros to ``size``, at length one, in double precision."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), size))
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), place] = values
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors; empty cells keep their centre."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, 1 + len(sample) // 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _assign(centres: np.ndarray, margin: float):
    """Every entry with its home and the cells it visits."""
    size = centres.shape[1]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                near = unit_rows(part.column("vector"), size) @ centres.T
                home = near.argmax(axis=1)
                close = near >= near.max(axis=1, keepdims=True) - margin
                close[np.arange(len(home)), home] = False
                visits = [np.flatnonzero(c).tolist() for c in close]
                cells = pa.schema([("home", pa.int32()), ("visits", pa.list_(pa.int32()))])
                done = rows(cells, {"home": home.tolist(), "visits": visits})
                yield pa.RecordBatch.from_arrays([*part.columns, *done.columns], names=[*part.schema.names, *cells.names])

    return run


def _compare(size: int, threshold: float):
    """Links of each group: entry, the number of vectors it is linked with here, an entry it is joined to."""
    links = pa.schema([("id", pa.int64()), ("n_links", pa.int64()), ("joined", pa.int64())])

    def found(cell: int, group: pa.Table) -> pa.RecordBatch:
        ids, times, home = (group.column(n).to_numpy() for n in ("least", "times", "home"))
        guest = group.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        visits = group.column("visits").to_pylist()
        vectors = unit_rows(group.column("vector").combine_chunks(), size)
        members, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
        inner = bool(group.column("inner")[0].as_py())
        near = vectors[members] @ vectors[members if inner else guests].T >= threshold
        first, second = np.nonzero(np.triu(near, 1) if inner else near)
        first, second = members[first], (members if inner else guests)[second]
        # A pair of different homes is seen in both if each visits the other's: then the smaller cell counts it.
        seen = {i: set(visits[i]) for i in np.unique(first[home[second] < cell])}
        kept = [home[b] >= cell or int(home[b]) not in seen[a] for a, b in zip(first, second)]
        first, second = first[kept], second[kept]
        counts = np.bincount(first, weights=times[second], minlength=len(ids)) + np.bincount(second, weights=times[first], minlength=len(ids))
        joined = ids.copy()
        place = {int(v): i for i, v in enumerate(ids)}
        for root, own in spanning(first, second, ids):
            joined[place[own]] = root
        linked = np.flatnonzero(counts)
        return rows(links, {"id": ids[linked], "n_links": counts[linked].astype(np.int64), "joined": joined[linked]})

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("cell", "own", "other")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for start, end in zip(starts, np.r_[starts[1:], len(keys)]):
                if key is not None and tuple(keys[start]) != key:
                    yield found(key[0], pa.Table.from_batches(held))
                    held = []
                key = tuple(keys[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield found(key[0], pa.Table.from_batches(held))

    return run


def _blocks(assigned: DataFrame) -> DataFrame:
    """Entries dealt to groups (cell, own, other): members of block ``own`` against those of block ``other``, or guests."""
    homes = assigned.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    guests = assigned.select(F.explode("visits").alias("cell")).groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("guest_blocks")
    )
    sizes = homes.join(guests, "cell", "left").na.fill(0, ["guest_blocks"])
    part = lambda n: F.pmod(F.xxhash64("least"), n).cast("int")
    entry = ("least", "times", "vector", "home", "visits")
    at_home = assigned.join(sizes, assigned["home"] == sizes["cell"]).withColumn("block", part(F.col("blocks")))
    row = F.struct(F.col("block").alias("own"), F.col("block").alias("other"), F.lit(True).alias("inner"), F.lit(False).alias("guest"))
    higher = F.transform(
        F.when(F.col("block") + 1 < F.col("blocks") + F.col("guest_blocks"), F.sequence(F.col("block") + 1, F.col("blocks") + F.col("guest_blocks") - 1)).otherwise(F.array().cast("array<int>")),
        lambda b: F.struct(F.col("block").alias("own"), b.alias("other"), F.lit(False).alias("inner"), F.lit(False).alias("guest")),
    )
    lower = F.transform(
        F.when(F.col("block") > 0, F.sequence(F.lit(0), F.col("block") - 1)).otherwise(F.array().cast("array<int>")),
        lambda b: F.struct(b.alias("own"), F.col("block").alias("other"), F.lit(False).alias("inner"), F.lit(True).alias("guest")),
    )
    inside = at_home.select(*entry, "cell", F.inline(F.concat(F.array(row), higher, lower)))
    visiting = (
        assigned.select(*entry, F.explode("visits").alias("cell"))
        .join(sizes, "cell")
        .withColumn("block", F.col("blocks") + part(F.col("guest_blocks")))
        .select(*entry, "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.col("block").alias("other"))
        .select(*entry, "cell", "own", "other", F.lit(False).alias("inner"), F.lit(True).alias("guest"))
    )
    return inside.unionAll(visiting)


def near_embeddings(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    margin: float = 0.15,
    cell_size: int = 512,
    max_cells: int = 4096,
    sample_size: int = 1 << 14,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    n_links counts the other vectors found at a cosine of at least ``threshold``, component_id is the smallest id
    reachable by such links, itself included, and kept marks the row that has that id. Centres are
    fitted on at most ``sample_size`` distinct vectors, chosen by hash; all vectors are compared. With a ``cell_size`` above
    the number of vectors there is one cell, and all pairs are compared in blocks: exact, at a cost that grows with the square.

    * Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, not even their equals.
    * Shorter vectors count as filled up with zeros.
    * Rows of equal vectors are linked with each other, whatever their ids or other columns.
    * Ids are whole numbers; another type raises ValueError.
    * Only the two named columns are read. An empty table gives an empty table.
    """
    kind = whole_numbers(vectors, vec_id)
    named = vectors.select(
        F.col(vec_id).alias("vec_id"), F.when(comparable(F.col(vector)), F.col(vector)).alias("vector")
    )
    classes = stored(
        named.where("vector is not null").groupBy("vector").agg(F.min("vec_id").cast("long").alias("least"), F.count(F.lit(1)).alias("times")),
        "vectors",
    )
    size = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = classes.orderBy(F.xxhash64("vector"), "least").limit(sample_size).select("vector").toArrow().column(0).combine_chunks()
    cells = max(1, min(max_cells, len(sample) // 4, count_of(classes) // cell_size))
    centres = fit_centres(unit_rows(sample, size), cells) if len(sample) else np.zeros((1, size))
    fields = classes.schema["vector"].dataType.simpleString()
    shape = f"least long, times long, vector {fields}, home int, visits array<int>"
    assigned = stored(classes.select("least", "times", "vector").mapInArrow(_assign(centres, margin), shape), "cells")
    groups = ["cell", "own", "other"]
    dealt = _blocks(assigned).repartition(*groups).sortWithinPartitions(*groups)
    found = stored(dealt.mapInArrow(_compare(size, threshold), "id long, n_links long, joined long"), "found")
    joined = components(found.select(F.col("joined").alias("a"), F.col("id").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    placed = (
        classes.join(counts, classes["least"] == counts["id"], "left")
        .drop("id")
        .join(joined, classes["least"] == joined["id"], "left")
        .select("vector", "least", (F.coalesce("n_links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component")
    )
    rest = named.join(placed, "vector", "left")
    component = F.coalesce("component", "least", "vec_id").cast(kind)
    return rest.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
