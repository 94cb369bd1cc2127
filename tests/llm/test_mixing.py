"""Mixes of sources: targets by a plain computation, samples near them, inclusion in proportion."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablepact.llm.mixing import mix_documents, plan_mix, running_total

DOCS = "doc_id long, text string, source string"


def targets(sizes, weights=(3, 1, 2), share=1.5, copies=2):
    """{source: target}: shared out again until no target is above its limit."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    words, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = words / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= copies * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: float(copies * sizes[s]) for s in over}
        words, free = words - sum(copies * sizes[s] for s in over), free - over
    return out


def plain_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def checked(rows, docs, near, **settings):
    """One row per document, right sizes and targets, and the words taken of each source."""
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += plain_size(text)
    wanted = targets(sizes, **settings)
    assert sorted(((r.doc_id, r.source, r.size) for r in rows), key=str) == sorted(((d, s, plain_size(t)) for d, t, s in docs), key=str)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= settings.get("copies", 2)
        certain = int(wanted[r.source] / sizes[r.source]) if sizes[r.source] else 0
        assert r.copies in (certain, certain + 1)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for source, words in taken.items():
        assert abs(words - wanted[source]) <= max(1, min(near * wanted[source], longest[source] / 2))
    return taken


def test_query_is_near_its_targets_and_agrees_with_itself(spark):
    from tablepact.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = plan_mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    checked(rows, docs, 0.002)
    again = {r.doc_id: r.taken for r in QUERIES["op12_mixing"](spark, folder).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_one_hot_source_and_giant_documents(spark):
    """A third of all rows in one source, giants that fit no rest, sources at their limit."""
    docs = [(i, "w " * (1 + i % 40), "hot" if i % 3 == 0 else f"s{i % 50}") for i in range(3000)]
    docs += [(9000 + i, "v " * 30_000, "hot") for i in range(3)] + [(9100 + i, "v " * 3_000, "s1") for i in range(4)]
    checked(plan_mix(spark.createDataFrame(docs, DOCS).repartition(5)).collect(), docs, 1)


def test_odd_documents(spark):
    docs = [
        (1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e", None), (None, "d e", None), (4, " \t\x0b ", "empty"),
        (5, "é ü  ", "é"), (6, "one", "Z"), (7, "f " * 400_000, "long"), (8, "g h", ""),
    ]
    checked(plan_mix(spark.createDataFrame(docs, DOCS)).collect(), docs, 1)
    clash = spark.createDataFrame([(*d, 1, 2.0, "z", 3) for d in docs], f"{DOCS}, size int, target double, row string, copies int")
    checked(plan_mix(clash).collect(), docs, 1)
    assert plan_mix(clash.where("false")).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in plan_mix(clash.where("size(split(text, 'g')) = 0 or text is null")).collect())
    text_ids = spark.createDataFrame([("a", "x y", "s"), ("b", "z", "s")], "doc_id string, text string, source string")
    assert {r.doc_id for r in plan_mix(text_ids).collect()} == {"a", "b"}
    for settings in ({"weights": ()}, {"weights": (1, 0)}, {"share": 3}):
        with pytest.raises(ValueError):
            plan_mix(clash, **settings)


def test_settings(spark):
    docs = [(i, "w " * (i % 9), f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(docs, DOCS)
    for settings in ({"weights": (5, 1), "share": 0.3}, {"weights": (1,), "share": 3.2, "copies": 4}, {"share": 2.0}, {"share": 0}):
        checked(plan_mix(df, **settings).collect(), docs, 0.05, **settings)


def test_mixed_documents_are_whole_rows(spark):
    docs = [(i, f"t{i} " * (1 + i % 5), f"s{i % 3}", "kept", i) for i in range(60)]
    df = spark.createDataFrame(docs, f"{DOCS}, row string, key long")
    mixed, plan = mix_documents(df), {r.doc_id: r.copies for r in plan_mix(df).collect()}
    assert mixed.columns == df.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == pytest.approx(1.5 * sum(1 + i % 5 for i in range(60)), abs=3)
    assert len(plan) == 60 and {tuple(r) for r in mixed.collect()} <= set(docs)


def test_inclusion_follows_the_share(spark):
    """Over many seeds, documents of every size are sampled about as often as their source's share asks."""
    docs = [(i, "w " * (1 + i % 7), "only") for i in range(1200)]
    df, runs = spark.createDataFrame(docs, DOCS).coalesce(1), 4
    extra = defaultdict(int)
    for seed in range(runs):
        for r in plan_mix(df, share=1.3, seed=seed).collect():
            extra[r.size] += r.copies - 1
    of_size = defaultdict(int)
    for i, _, _ in docs:
        of_size[1 + i % 7] += 1
    assert all(0.2 < extra[size] / runs / of_size[size] < 0.4 for size in of_size)


def test_running_totals_cross_ranges(spark):
    df = spark.createDataFrame([(i % 3 or None, i, i % 11) for i in range(300) if i % 3], "key int, at int, n int")
    rows = running_total(df.repartition(4), "key", [F.col("at")], F.col("n")).collect()
    for r in rows:
        assert r.total == sum(i % 11 for i in range(r.at + 1) if i % 3 == r.key)
    assert len(rows) == 200
