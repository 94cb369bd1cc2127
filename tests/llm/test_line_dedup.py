"""Line deduplication against brute force, and the filters' guarantees."""

import hashlib

import numpy as np

from tablepact.llm import line_dedup
from tablepact.llm.line_dedup import SeenTwice, dedup_lines, key_hashes, probes
from tablepact.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def key_of(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def brute(texts):
    """{id: (lines before, lines dropped, kept text)}"""
    split = {i: (t or "").split("\n") for i, t in texts.items()}
    holders = {}
    for i, lines in split.items():
        for line in lines:
            holders.setdefault(key_of(line), set()).add(i)
    out = {}
    for i, lines in split.items():
        kept = [s for s in lines if len(key_of(s)) < 10 or len(holders[key_of(s)]) < 2 or min(holders[key_of(s)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op3_line_dedup"](spark, FOLDER).collect()}
    assert found == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in brute(texts).items()}


ODD = [
    None, "", "\n", "\n\n  \n", "A long line here\nx", " \t a LONG line here\x0b\r\nx\ny", "short\nshort\nshort", "äöüäöüäöü\näöüäöüäöüä",
    "Äöüäöüäöü\näöüäöüäöüä\näöüäöüäöüä", " a long line here", "the same line\nthe same line\nthe same line", "z" * 200_000 + "\nthe same line",
    "\n".join(f"line number {i} of many" for i in range(3000)), "\n".join(f"LINE number {i} of many " for i in range(0, 6000, 2)),
]


def checked(spark, texts, **options):
    rows = [(i, t, i, "k", 5) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lost long, key string, n_lines int").repartition(3)
    found = dedup_lines(docs, **options)
    assert found.columns == ["doc_id", "text", "lost", "key", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in found.collect()} == brute(texts)


def test_odd_texts(spark):
    checked(spark, dict(enumerate(ODD * 2)))


def test_full_filters_change_nothing(spark, monkeypatch):
    """A filter far too small suspects every line; segments are many."""
    monkeypatch.setattr(line_dedup, "SEGMENT_LINES", 64)
    checked(spark, dict(enumerate(ODD * 2)), filter_bytes=16)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "one line of text\nb"), (1, "one line of text"), (2, "one line of text"), (None, "one line of text"), (3, "only here twice"), (3, "only here twice")]
    found = sorted((str(r.doc_id), r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [
        ("1", "one line of text", 0), ("1", "one line of text\nb", 0), ("2", "", 1), ("3", "only here twice", 0), ("3", "only here twice", 0),
        ("None", "one line of text", 0),
    ]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filters_miss_nothing():
    keys = [b"key %d" % i for i in range(3000)]
    both = SeenTwice(1 << 15, 1 << 14)
    no = np.zeros(1000, bool)
    hashes = key_hashes(keys)
    for part in (hashes[:1000], hashes[1000:2000], hashes[2000:], hashes[500:1500]):
        both.add(part, no)
    assert both.twice[probes(hashes[500:1500], 1 << 14)].all(axis=0).all()
    assert both.twice[probes(np.r_[hashes[:500], hashes[1500:]], 1 << 14)].all(axis=0).mean() < 0.3
