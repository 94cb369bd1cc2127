"""Decontamination against a plain scan for windows, and the index against a plain search."""

import hashlib
import re

import numpy as np

from tablepact.llm import decontaminate
from tablepact.llm.decontaminate import find_contamination
from tablepact.llm.fm_index import FMIndex, suffix_order
from tablepact.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(text, items, length=10):
    """(number of words, places hit, item ids)"""
    words, hit, names = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        size = min(length, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for p in range(len(words) - size + 1 if windows else 0):
            if tuple(words[p : p + size]) in windows:
                hit |= set(range(p, p + size))
                names.add(item)
    return len(words), hit, names


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 250").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = {r.doc_id: r for r in QUERIES["op6_decontamination"](spark, FOLDER).collect()}
    for d in docs:
        n, hit, names = brute(d.text, items)
        r = found[d.doc_id]
        listed = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(names), listed, bool(hit))
    assert sum(r.contaminated for r in found.values()) > 0


ITEMS = [
    (1, "alpha beta gamma"), (2, "a b c d e f g h i j k l"), (10, "A b c d e f g h i j"), (3, None), (4, ""), (5, "..."), (6, "Über straße"),
    (2, "x x"), (None, "nameless item here"), (7, "w " * 15),
]
TEXTS = [
    None, "", "?!", "alpha, beta; GAMMA alpha beta delta", "a b c d e f g h i j k l m", "b c d e f g h i j k", "a b c d e f g h i", "x x x x", "Über Straße über straße",
    "the nameless item here", "w " * 9, "w " * 40, "q " * 50_000 + "alpha beta gamma", "z" * 100_000,
]


def checked(spark, **options):
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, spans int, rest string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = find_contamination(docs.repartition(2), items, **options).collect()
    assert len(found) == len(TEXTS) * 2 and all(r.rest == "r" for r in found)
    for r in found:
        n, hit, names = brute(r.text, ITEMS)
        assert r.n_words == n and {w for s in r.spans for w in range(s.first, s.end)} == hit
        assert r["items"] == sorted(str(x) for x in names - {None})
        assert all(a.end < b.first for a, b in zip(r.spans, r.spans[1:]))
    assert find_contamination(docs.where("false"), items).count() == 0
    assert all(not r.spans for r in find_contamination(docs, items.where("false")).collect())


def test_odd_texts(spark):
    checked(spark)


def test_benchmark_in_blocks_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 40)
    checked(spark, block_bytes=40)


def test_index_finds_every_place():
    rng = np.random.default_rng(4)
    for text in (rng.integers(1, 4, 500), np.ones(200, int), np.arange(1, 60)):
        index = FMIndex(text, int(text.max()) + 1)
        phrases = [text[i : i + n] for n in (1, 2, 5, 9) for i in range(0, len(text) - n, 7)] + [np.array([int(text.max()) + 1, 1])]
        lengths = np.array([len(p) for p in phrases])
        table = np.zeros((len(phrases), lengths.max()), np.int64)
        for row, p in zip(table, phrases):
            row[: len(p)] = p
        low, high = index.search(table, lengths)
        for p, a, b in zip(phrases, low, high):
            wanted = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == wanted


def test_suffix_order():
    text = np.array([2, 1, 2, 1, 2, 0])
    assert suffix_order(text).tolist() == sorted(range(6), key=lambda i: text[i:].tolist())
