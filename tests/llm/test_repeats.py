"""Removal of repeated byte strings against a table of all windows."""

import hashlib

import numpy as np
import pytest

from tablepact.llm import passages, repeats
from tablepact.llm.queries import QUERIES
from tablepact.llm.repeats import least_places, longest_factors, remove_repeats, repeated_windows, suffix_order

FOLDER = "/root/testdata/sf0.001"


def brute(texts, length, keep_first=False):
    """Per text (bytes, removed, runs, kept)."""
    raw = [(t or "").encode() for t in texts]
    places = {}
    for d, text in enumerate(raw):
        for i in range(len(text) - length + 1):
            places.setdefault(text[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in raw]
    for own in places.values():
        for d, i in own[keep_first:] if len(own) > 1 else ():
            gone[d][i : i + length] = b"\1" * length
    out = []
    for text, marks in zip(raw, gone):
        runs = sum(1 for i, m in enumerate(marks) if m and (i == 0 or not marks[i - 1]))
        out.append((len(text), sum(marks), runs, bytes(c for c, m in zip(text, marks) if not m)))
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op5_repeats"](spark, FOLDER).collect()}
    wanted = brute([d.text for d in docs], 400)
    assert found == {d.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in zip(docs, wanted)}
    assert any(w[1] for w in wanted)


def edited(seed, copies=60, size=900):
    """Near copies of a text with an edit each, a passage in many contexts, periodic texts, exact copies."""
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    base, passage = word(size), word(150)
    out = [base[: (i := int(rng.integers(size)))] + "éX" + base[i:] for _ in range(copies)]
    out += [word(int(rng.integers(200))) + passage + word(int(rng.integers(200))) for _ in range(copies)]
    out += [None, "", "ab" * 400, "ab" * 300, "z" * 700, "z" * 99, base + base, word(100), word(2000)]
    return out + [out[0]] * 3


@pytest.mark.parametrize("options", [{}, {"group": 8}, {"group": 0}, {"keep_first": True}])
def test_edited_copies(spark, monkeypatch, options):
    texts = edited(7)
    monkeypatch.setattr(repeats, "SHARD", 5000)
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, doc string, start long").coalesce(1)
    found = remove_repeats(docs, length=100, **options)
    assert found.columns == ["doc_id", "doc", "start", "kept", "n_bytes", "n_removed", "n_spans"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()}
    wanted = dict(enumerate(brute(texts, 100, options.get("keep_first", False))))
    assert {i: g for i, g in got.items() if g != wanted[i]} == {}
    assert remove_repeats(docs.where("false"), length=100).count() == 0


def test_windows_in_text_order():
    rng = np.random.default_rng(1)
    contents = [bytes(rng.integers(97, 99, int(n)).tolist()) for n in rng.integers(20, 60, 30)]
    for length in (16, 17, 20):
        previous, following = repeated_windows(contents, length)
        seen, places = set(), [(c, i) for c in range(30) for i in range(len(contents[c]) - length + 1)]
        for c, i in places:
            window = contents[c][i : i + length]
            assert previous[c][i] == (window in seen)
            seen.add(window)
        seen = set()
        for c, i in reversed(places):
            window = contents[c][i : i + length]
            assert following[c][i] == (window in seen)
            seen.add(window)


def test_least_places():
    values = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert least_places(values, 3).tolist() == [1, 1, 4, 4, 4]


def common(a, b, most):
    n = 0
    while n < most and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("length", [3, 8, 13, 20, 47])
def test_longest_factors_against_all_pairs(length):
    """Orders, common prefixes and longest previous and following factors of periodic and random bytes."""
    rng = np.random.default_rng(length)
    text = bytes(rng.integers(97, 99, 150).tolist()) + b"ab" * 60 + b"c" * 70 + bytes(rng.integers(97, 100, 60).tolist())
    places = np.flatnonzero(rng.random(len(text) - length + 1) < 0.8)
    order, lcp = suffix_order(text, places, length)
    cut = lambda p: text[p : p + length]
    assert order.tolist() == sorted(places.tolist(), key=lambda p: (cut(p), p))
    assert lcp.tolist() == [0] + [common(cut(a), cut(b), length) for a, b in zip(order.tolist(), order[1:].tolist())]
    before, after = longest_factors(order, lcp), longest_factors(-order, lcp)
    for k, p in enumerate(order.tolist()):
        assert before[k] == max([common(cut(p), cut(q), length) for q in places.tolist() if q < p], default=0)
        assert after[k] == max([common(cut(p), cut(q), length) for q in places.tolist() if q > p], default=0)


@pytest.mark.parametrize("keep_first", [False, True])
def test_hot_copies(spark, monkeypatch, keep_first):
    """Halves copied very often are found without bringing their rows together, with those copied rarely beside them."""
    monkeypatch.setattr(repeats, "HOT", 5)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    hot, rare = word(300), word(250)
    texts = [hot] * 40 + [rare + "x"] * 3 + [word(10) + hot + word(10) for _ in range(10)] + [word(200) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, length=100, keep_first=keep_first).collect()}
    assert got == dict(enumerate(brute(texts, 100, keep_first)))


def brute_passages(texts, size):
    """Per text the passages of ``size`` words that another text holds, overlapping ones as one, and their words."""
    words = [(t or "").encode().split() for t in texts]
    holders = {}
    for d, own in enumerate(words):
        for i in range(len(own) - size + 1):
            holders.setdefault(tuple(own[i : i + size]), set()).add(d)
    out = []
    for own in words:
        places = [i for i in range(len(own) - size + 1) if len(holders[tuple(own[i : i + size])]) > 1]
        runs = sum(1 for n, i in enumerate(places) if not n or places[n - 1] + size <= i)
        out.append((runs, len({j for i in places for j in range(i, i + size)})))
    return out


def worded(seed):
    """Texts with passages of others, edited, in other white space, more than once in one text, and many times."""
    rng = np.random.default_rng(seed)
    prose = lambda n: ["".join(map(chr, rng.integers(97, 123, int(k)))) for k in rng.integers(1, 9, n)]
    spaced = lambda ws: "".join(w + " \n\t\r\x0b\x0c"[int(k)] for w, k in zip(ws, rng.integers(0, 6, len(ws))))
    out = [None, "", " \n", "é" * 30, "a " * 400, "a " * 300, "a b " * 100, " ".join(prose(11)), "x" * 9000 + " " + " ".join(prose(30))]
    for k in (10, 11, 12, 13, 25, 60):
        passage = prose(k)
        out += [spaced(prose(20) + passage + prose(20)), spaced(passage + prose(3) + passage), "  " + spaced(prose(7) + passage)]
    alone = prose(30)
    out.append(" ".join(alone + prose(5) + alone))
    base, often = prose(200), prose(15)
    for _ in range(25):
        i = int(rng.integers(200))
        out += [spaced(base[:i] + prose(1) + base[i + 1 :]), spaced(prose(int(rng.integers(20))) + often + prose(9))]
    # A run with both neighbours in one text twice, and in another without them.
    one, left, right = prose(20), prose(30), prose(30)
    out += [" ".join(left + one + right + prose(4) + left + one + right), " ".join(prose(9) + one + prose(9))]
    return out + [out[-4]] * 8


@pytest.mark.parametrize("size, hot, group", [(5, repeats.HOT, repeats.GROUP), (12, repeats.HOT, 2), (5, 3, 0), (12, 3, repeats.GROUP)])
def test_passages(spark, monkeypatch, size, hot, group):
    """Told by words, whatever their bytes, with nothing removed for them."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SAMPLE", 32 if hot == repeats.HOT else 2)
    texts = worded(size)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = remove_repeats(docs, group=group, passage=size)
    assert found.columns == ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_words"]
    got = {r.doc_id: ((r.n_passages, r.n_passage_words), (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in found.collect()}
    wanted = dict(enumerate(zip(brute_passages(texts, size), brute(texts, 400))))
    assert {i: (g, wanted[i]) for i, g in got.items() if g != wanted[i]} == {}
    assert len(got) == len(texts)


def test_passages_under_400_bytes(spark):
    """51 words of 300 bytes in two texts: nothing to remove, but told; 50 words are not."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(n))
    told, short = prose(51), prose(50)
    texts = [f"{prose(40)} {told} {prose(40)}", f"{prose(9)}\n{told}", f"{short} {prose(30)}", f"{prose(30)} {short}", prose(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_passages, r.n_passage_words) for r in remove_repeats(docs, passage=51).collect())
    assert got == [(0, 0, 1, 51), (1, 0, 1, 51), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0)]


def test_passages_of_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = {r.doc_id: (r.n_passages, r.n_passage_words) for r in QUERIES["op5_repeats"](spark, FOLDER).collect()}
    assert found == {d.doc_id: w for d, w in zip(docs, brute_passages([d.text for d in docs], 51))}
    assert any(w for _, w in found.values())


def test_pieces_hold_every_window_once():
    """A text in pieces, a word longer than a piece in it, gives the windows it gives as a whole."""
    text = worded(2)[-1].encode() + b" " + b"y" * 700 + b" " + b"z z" * 90


    def windows(texts, shard):
        for part in passages.pieces(texts, 6, shard):
            for _, at, piece in part:
                _, start, end, one, two = (a.tolist() for a in passages.windows_of([piece], 6))
                yield from zip([at + s for s in start], [at + e for e in end], one, two)

    assert list(windows([b"", text], 200)) == list(windows([text], 1 << 20))
    assert len(list(passages.pieces([text], 6, 200))) > 3
