"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass over the labelled texts: tasks count in arrays, and the counts are summed by one
aggregate. The table of log-probabilities, ``buckets`` rows by one column per language, goes to all
tasks; its size is bounded by ``max_languages``. Scoring is one map: the grams of a text are counted
into a sparse row that is multiplied with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.shared import marker, rows

UNDETERMINED = "und"

#: Code points of a text that are counted at a time.
CHUNK = 1 << 20

SIZES = (1, 2, 3)


def gram_counts(text: str, buckets: int) -> np.ndarray:
    """How often the n-grams of the lower-cased text fall into each bucket."""
    total = np.zeros(buckets, np.int64)
    overlap = max(SIZES) - 1
    for start in range(0, len(text), CHUNK):
        before = min(start, overlap)
        piece = text[start - before : start + CHUNK].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        mixed = np.zeros(len(codes), np.uint64)
        for size in SIZES:
            if len(codes) < size:
                break
            mixed = mixed[: len(codes) - size + 1] * np.uint64(0x100000001B3) + codes[size - 1 :] + np.uint64(size)
            hashed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            fresh = hashed[max(0, before - size + 1) :] if before else hashed
            total += np.bincount((fresh % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, set(text)))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_probabilities: np.ndarray

    def scores(self, text: str) -> tuple[str, float]:
        """The likeliest language and its share; long texts are tempered, as their grams are not independent."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        counts = gram_counts(text, len(self.log_probabilities))
        present = counts.nonzero()[0]
        likelihood = counts[present] @ self.log_probabilities[present] / np.sqrt(counts.sum())
        best = int(likelihood.argmax())
        return self.languages[best], float(1 / np.exp(likelihood - likelihood[best]).sum())


def learn_languages(
    labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 14, max_languages: int = 1000
) -> LanguageModel:
    """A model from all rows with a language and a text. Without any such row it knows no language."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(name, np.zeros(buckets, np.int64))
                own += gram_counts(body, buckets)
        for name, own in counts.items():
            present = own.nonzero()[0]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([name] * len(present), pa.string()),
                    "bucket": pa.array(present, pa.int32()),
                    "n": pa.array(own[present], pa.int64()),
                }
            )

    given = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counted = given.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} languages; max_languages is {max_languages}")
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((buckets, len(languages)))
    columns = np.array([place[name] for name in table.column("lang").to_pylist()], np.int64)
    counts[table.column("bucket").to_numpy(), columns] = table.column("n").to_numpy()
    smoothed = counts + 0.5
    return LanguageModel(languages, np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32))


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).

    * Texts that are null or have no letter, and all texts if the model knows no language, get ``und`` and 0.
    * Of equally likely languages the first by name is taken.
    * Whole texts count, however long. Columns named lang_pred or score are replaced; others stay.
    """
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    body = F.struct(F.lit(True).alias(marker(docs)), *[F.col(f"`{c}`") for c in rest])
    framed = docs.select(body.alias("rest"), F.col(text).alias("text"))
    shape = framed.schema["rest"].dataType.simpleString()
    found = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            scored = [model.scores(body or "") for body in batch.column("text").to_pylist()]
            done = rows(found, {"lang_pred": [s[0] for s in scored], "score": [s[1] for s in scored]})
            yield pa.RecordBatch.from_arrays(
                [batch.column("rest"), batch.column("text"), *done.columns], names=["rest", "text", *found.names]
            )

    scored = framed.mapInArrow(run, f"rest {shape}, text string, lang_pred string, score double")
    return scored.select(F.col("text").alias(text), *[F.col(f"rest.`{c}`") for c in rest], "lang_pred", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from the documents with an id that are not held out."""
    return learn_languages(docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)), text, lang)
