"""A corpus pipeline of five stages over ``documents``; every stage is an operator of tablepact.llm.

Each stage gets what the one before has kept, stored as Parquet. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.decontaminate import find_contamination
from tablepact.llm.language_id import UNDETERMINED, identify_languages, learn_from_documents
from tablepact.llm.line_dedup import dedup_lines
from tablepact.llm.packing import pack
from tablepact.llm.queries import TOKENIZER
from tablepact.llm.shared import stored, table
from tablepact.llm.simhash import without_near_duplicates

#: A document whose likeliest language has a smaller share is rejected.
SURE_OF_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; those without letters, or in no language clearly, go."""
    found = identify_languages(docs, learn_from_documents(docs))
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= SURE_OF_LANGUAGE)
    return found.where(sure).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of a smaller id holds; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group, of the smallest id: three-word shingles, links at two differing bits or fewer."""
    return without_near_duplicates(docs, size=3)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Learned languages, XXH64 fingerprints and the tokenizer's ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
