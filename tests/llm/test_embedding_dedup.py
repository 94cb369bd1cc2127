"""Embedding near-duplicates against all pairs by brute force."""

import math

import numpy as np
import pytest

from tablepact.llm.embedding_dedup import near_embeddings
from tablepact.llm.queries import QUERIES


def brute(vectors, threshold=0.9):
    """{id: (n_links, component)} by all pairs."""
    ids = sorted(vectors)
    size = max([len(v) for v in vectors.values() if v] or [1])
    good = [
        i for i in ids
        if vectors[i] and all(x is not None and math.isfinite(x) for x in vectors[i]) and any(vectors[i])
    ]
    m = np.array([list(vectors[i]) + [0.0] * (size - len(vectors[i])) for i in good], np.float64).reshape(-1, size)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    near = m @ m.T >= threshold - 1e-12
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        x, y = sorted((find(good[a]), find(good[b])))
        root[y] = x
    links = {i: int(near[k].sum()) - 1 for k, i in enumerate(good)}
    return {i: (links.get(i, 0), find(i)) for i in ids}


def answers(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    found = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_on_the_largest_table(spark):
    """Recall against brute force; nothing below the threshold is linked."""
    folder = "/root/testdata/sf0.1"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    found, wanted = answers(QUERIES["op10_embedding_dedup"](spark, folder)), brute(vectors)
    assert found.keys() == wanted.keys()
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in wanted.values())


def test_many_cells_and_blocks(spark, monkeypatch):
    """Small cells: links across borders are found; small blocks: every pair is counted once."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    near = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), np.repeat(base[:1], 300, 0) * rng.uniform(0.5, 2, (300, 1))])
    vectors = {i: v.astype(np.float32).tolist() for i, v in enumerate(near)}
    rows = [(i, v) for i, v in vectors.items()]
    monkeypatch.setattr("tablepact.llm.embedding_dedup.BLOCK", 32)
    found = answers(near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell_size=40))
    wanted = brute(vectors)
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    assert sum(n for n, _ in found.values()) >= 0.98 * sum(n for n, _ in wanted.values())
    assert found[0] == wanted[0] and found[449] == wanted[449]


def crowd(seed=2, groups=700, size=16):
    """Groups of four vectors whose cosines lie on both sides of the threshold: thousands of links, many between cells."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, size))
    noise = rng.uniform(0.1, 0.5, (4, groups, 1)) * rng.normal(size=(4, groups, size))
    return {i: v.tolist() for i, v in enumerate((base + noise).reshape(-1, size).astype(np.float32))}


@pytest.mark.parametrize(("cell_size", "recall"), [(44, 0.95), (5, 0.9), (1 << 40, 1.0)])
def test_recall_where_there_is_something_to_find(spark, cell_size, recall):
    """64 cells, 512 cells, and one cell, which compares all pairs in blocks and is exact."""
    vectors = crowd()
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    found, wanted = answers(near_embeddings(df, cell_size=cell_size, max_cells=512)), brute(vectors)
    links = sum(n for n, _ in wanted.values())
    assert links > 2000 and len({c for _, c in wanted.values()}) < len(vectors) - 500
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    assert sum(n for n, _ in found.values()) >= recall * links
    if recall == 1:
        assert found == wanted


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = dict(enumerate([
        [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [0.0, 0.0], None, None, [], [nan, 1.0], [nan, 1.0], [inf, 1.0], [None, 1.0],
        [1.0], [0.0, 1.0], [-0.0, 1.0], [0.95, 0.3], [1e30, 1e30], [1e-30, 1e-30],
    ]))
    rows = [(i, v, 1, "x", i) for i, v in vectors.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, least int, vector string, home long")
    assert answers(near_embeddings(df)) == brute(vectors)
    assert near_embeddings(df.where("false")).count() == 0
    assert near_embeddings(df.where("embedding is null")).count() == 2
