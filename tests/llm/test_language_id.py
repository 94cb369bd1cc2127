"""Language ID by held-out accuracy, and defined results for odd texts."""

import math
import zlib
from collections import Counter

from tablepact.llm import language_id
from tablepact.llm.language_id import UNDETERMINED, gram_counts, held_out, identify_languages, learn_from_documents, learn_languages
from tablepact.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op4_language_id"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_odd_texts(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("aaa bbb", "a"), ("ccc ddd", "c"), ("eee", None), (None, "a")] * 6)]
    model = learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert model.languages == ["a", "c"]
    texts = [None, "", "123 !?", "AAA bbb", "ddd", "zzz", "a" * 3_000_000, "٣ ½ ²", "é"]
    docs = spark.createDataFrame([(t, 1, "k") for t in texts * 2], "text string, score int, rest string")
    found = identify_languages(docs, model)
    assert found.columns == ["text", "rest", "lang_pred", "score"]
    got = {r.text: r.lang_pred for r in found.collect()}
    assert [got[t] for t in texts[:5]] == [UNDETERMINED] * 3 + ["a", "c"] and got["a" * 3_000_000] == "a"
    assert got["٣ ½ ²"] == UNDETERMINED and got["é"] in ("a", "c")
    assert identify_languages(docs.where("false"), model).count() == 0
    nothing = learn_languages(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in identify_languages(docs, nothing).collect()} == {UNDETERMINED}


def test_held_out_and_missing_documents_teach_nothing(spark):
    rows = [(i, "abc", str(zlib.crc32(str(i).encode()) % 3)) for i in range(30)] + [(None, "abc", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn_from_documents(docs).languages == ["0", "2"]
    assert docs.where("doc_id is null").select(held_out()).first()[0] is False


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(5000))
    whole = gram_counts(text, 512)
    monkeypatch.setattr(language_id, "CHUNK", 97)
    assert (gram_counts(text, 512) == whole).all() and whole.sum() == 3 * 5000 - 3


def grams_one_by_one(text, buckets):
    counts = Counter()
    text = text.lower()
    for start in range(len(text)):
        mixed = 0
        for size, char in enumerate(text[start : start + 3], 1):
            mixed = (mixed * 0x100000001B3 + ord(char) + size) % 2**64
            counts[(mixed * 0x9E3779B97F4A7C15 % 2**64 >> 40) % buckets] += 1
    return counts


def test_query_against_naive_bayes_gram_by_gram(spark):
    folder, buckets = "/root/testdata/sf0.001", 1 << 14
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    grams = {r.doc_id: grams_one_by_one(r.text or "", buckets) for r in docs}
    learned = {}
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            learned.setdefault(r.lang, Counter()).update(grams[r.doc_id])
    totals = {lang: sum(c.values()) + 0.5 * buckets for lang, c in learned.items()}
    for row in QUERIES["op4_language_id"](spark, folder).collect():
        own = grams[row.doc_id]
        if not own:
            assert (row.lang_pred, row.score) == (UNDETERMINED, 0.0)
            continue
        root = math.sqrt(sum(own.values()))
        likely = {
            lang: sum(n * math.log((c[g] + 0.5) / totals[lang]) for g, n in own.items()) / root for lang, c in learned.items()
        }
        best = max(sorted(likely), key=likely.get)
        share = 1 / sum(math.exp(x - likely[best]) for x in likely.values())
        # Probabilities are kept in single precision.
        near = {lang for lang, x in likely.items() if x > likely[best] - 1e-3}
        assert row.lang_pred in near and abs(row.score - share) < 1e-3, (row, likely)
