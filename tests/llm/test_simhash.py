"""SimHash components against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F
from tablepact.llm.queries import QUERIES
from tablepact.llm.simhash import GrayIndex, gray_rank, level_masks, near_duplicates, near_links, spanning

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """Components of {id: fingerprint} by all pairs."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 2):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    components = brute(prints)
    found = QUERIES["op7_simhash"](spark, FOLDER).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints and len(found) == len(texts)
    assert {r.doc_id: r.component_id for r in found} == components
    assert len(set(components.values())) < len(components)


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "One", "one", "A b c", "a B C d", "é \x1c x", "x" * 100_000, "w " * 100_000] * 2
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint int, key string")
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    prints = {i: plain(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint % (1 << 64) for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == brute(prints)
    assert near_duplicates(docs.where("false")).count() == 0
    alone = near_duplicates(spark.createDataFrame([(None, "a"), (None, "a"), (3, "b c d e f g")], "doc_id long, text string"))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in alone.collect()) == [("3", "3"), ("None", "None"), ("None", "None")]


@pytest.mark.parametrize("group", [256, 16, 2])
def test_crowded_patterns_are_parted(spark, group):
    """Links are the same however small the groups, down to the last level."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    prints = set()
    for _ in range(700):
        value = int(centres[rng.integers(4)])
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            value ^= 1 << int(bit)
        prints.add(value)
    prints |= {int(centres[0]) ^ low for low in range(60)}
    by_id = dict(enumerate(sorted(prints)))
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in by_id.items()]
    links = near_links(spark.createDataFrame(rows, "fingerprint long, least long"), group).collect()
    assert all(bin(by_id[r.a] ^ by_id[r.b]).count("1") <= 60 for r in links)
    root = {i: i for i in by_id}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = sorted((find(r.a), find(r.b)))
        root[b] = a
    assert {i: find(i) for i in by_id} == brute(by_id)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 9, 300, dtype=np.uint64))
    first, second = GrayIndex(values).pairs()
    wanted = {(i, j) for j in range(len(values)) for i in range(j) if bin(int(values[i] ^ values[j])).count("1") <= 2}
    assert set(zip(first.tolist(), second.tolist())) == wanted


def test_masks_leave_room_for_two_differences():
    assert [len(level_masks(n)) for n in (1, 2, 3)] == [6, 36, 216]
    for bits in [(0, 1), (0, 63), (15, 16), (31, 40)]:
        for level in (1, 2, 3):
            assert any(not any(m >> b & 1 for b in bits) for m in level_masks(level))


def test_gray_order(spark):
    codes = [i ^ i >> 1 for i in range(64)]
    rows = spark.createDataFrame([(c,) for c in codes], "c long").orderBy(gray_rank(F.col("c"))).collect()
    assert [r.c for r in rows] == codes


def test_spanning_links_join_what_pairs_join():
    first, second = np.array([0, 1, 3]), np.array([1, 2, 4])
    assert sorted(spanning(first, second, np.array([9, 5, 7, 2, 8]))) == [(2, 8), (5, 7), (5, 9)]
