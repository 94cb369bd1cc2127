"""Every operator and stage on columns with the names they use inside, on ids that are text, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablepact.llm.decontaminate import find_contamination
from tablepact.llm.embedding_dedup import near_embeddings
from tablepact.llm.language_id import identify_languages, learn_from_documents
from tablepact.llm.licenses import scan_licenses
from tablepact.llm.line_dedup import dedup_lines
from tablepact.llm.mixing import mix_documents
from tablepact.llm.pii import find_pii
from tablepact.llm.queries import TOKENIZER
from tablepact.llm.packing import pack
from tablepact.llm.quality import score_quality
from tablepact.llm.repeats import remove_repeats
from tablepact.llm.simhash import near_duplicates, without_near_duplicates

FOLDER = "/root/testdata/sf0.001"
CLASHES = ["_", "__", "rest", "doc", "row", "_row", "_set", "lost", "_email", "_name", "_words", "words", "least", "id", "key", "size", "place", "part", "block"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "One two three mit license token = \"0a1b2c3d4e5f\"\nsame line of text here", "same line of text here\nmail a@b.co", " \t", "x" * 20_000, "w " * 30_000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(2, texts[2], "en", None, 1), (None, "no id", None, "s", 1)]
    rows += [(100 + i, f"learn these words from document {i}", "en", "s", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({name: F.lit(name) for name in CLASHES})


def benchmark(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet")


OPERATORS = {
    "pii": lambda docs: find_pii(docs),
    "lines": lambda docs: dedup_lines(docs),
    "languages": lambda docs: identify_languages(docs, learn_from_documents(docs)),
    "repeats": lambda docs: remove_repeats(docs),
    "contamination": lambda docs: find_contamination(docs, benchmark(docs.sparkSession)),
    "copies": lambda docs: without_near_duplicates(docs),
    "licenses": lambda docs: scan_licenses(docs),
    "mix": lambda docs: mix_documents(docs, share=1.0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_stay(docs, name):
    done = OPERATORS[name](docs)
    held = done.collect()
    assert held and set(CLASHES) <= set(done.columns)
    assert all(r[c] == c for r in held for c in CLASHES)
    if name not in ("copies", "mix"):
        assert len(held) == 15
    assert OPERATORS[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["near_duplicates", "pack", "quality"])
def test_operators_with_columns_of_their_own(docs, name):
    labels = docs.select(F.col("doc_id"), (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"), F.lit(1).alias("_"))
    run = {"near_duplicates": near_duplicates, "pack": lambda d: pack(d, TOKENIZER), "quality": lambda d: score_quality(d, labels)}[name]
    assert run(docs).count() >= 15
    assert run(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, docs, name):
    plain = docs.drop(*CLASHES)
    stage = dict(corpus_pipeline.STAGES)[name]
    done = stage(spark, plain, FOLDER)
    assert done.count() > 0
    if name != "packing":
        assert done.columns == plain.columns and done.schema.simpleString() == plain.schema.simpleString()
    assert stage(spark, plain.where("false"), FOLDER).count() == 0


def test_ids_that_are_no_numbers(spark, docs):
    text_ids = docs.drop(*CLASHES).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for run in (dedup_lines, near_duplicates):
        with pytest.raises(ValueError, match="whole numbers"):
            run(text_ids)
    with pytest.raises(ValueError, match="whole numbers"):
        near_embeddings(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))
    assert without_near_duplicates(text_ids).count() < text_ids.count()
    for run in (find_pii, remove_repeats, scan_licenses):
        assert run(text_ids).count() == 15


def test_copies_are_rows_not_ids(spark):
    """Repeated rows, shared ids and rows without an id: one row of each group stays."""
    one, two, three = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(1, one), (1, one), (2, one), (3, two), (3, three), (4, two), (2, three), (None, two), (None, "v w"), (None, "V w"), (None, None), (None, " "), (5, "x")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_copies(spark, df, "").collect()
    wanted = [(1, one), (3, two), (2, three), (None, "v w"), (None, ""), (5, "x")]
    assert sorted((str(r.doc_id), (r.text or "").lower().strip()) for r in kept) == sorted((str(i), t) for i, t in wanted)
