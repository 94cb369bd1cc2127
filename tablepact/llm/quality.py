"""Document quality by co-training two views.

One classifier sees the content of a text: the shapes of its words, and shares of letters, digits, marks and
repeated words. The other sees metadata of the page: source, language, declared length and line layout. Both
are naive Bayes over hashed features, so training is a sum of counts over all documents, and a
model is one number per feature. In each round, documents without a label that one view is sure of
are training examples of the other. At the end each view is calibrated on labelled documents
that no training has seen, and the calibrated views are combined.

Features are stored once, as two short arrays per document; each round is one map over them and a sum of bounded size.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.shared import arrow_pass, rows, stored, utf8

#: Features of a view.
BUCKETS = 1 << 12

#: Digits of log-odds that count.
DIGITS = 9

#: Letters as a and A, digits as 0, all beyond ASCII as a letter; the rest as it is.
KINDS = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)

RUN = re.compile(rb"(.)\1+")

VIEWS = ("content", "metadata")

#: Half-width and step of the grid on which scores are calibrated.
REACH, STEP = 8.0, 0.25


def bucket(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode("utf-8", "replace")) % BUCKETS


def graded(share: float) -> int:
    """A share on a scale that is finer near zero."""
    return int(round(10 * math.sqrt(max(0.0, min(1.0, share)))))


def content_features(raw: bytes) -> list[int]:
    kinds = raw.translate(KINDS)
    words, size = raw.lower().split(), max(1, len(raw))
    found = {bucket("shape", RUN.sub(rb"\1", shape)[:12]) for shape in set(kinds.split())}
    letters, capitals, digits = kinds.count(b"a"), kinds.count(b"A"), kinds.count(b"0")
    marks = size - letters - capitals - digits - kinds.count(b" ") - kinds.count(b"\n")
    grades = {
        "letters": letters / size, "capitals": capitals / size, "digits": digits / size, "marks": marks / size,
        "distinct": len(set(words)) / max(1, len(words)), "short": sum(len(w) < 4 for w in words) / max(1, len(words)),
    }
    # Shares tell more than single shapes, and count as four features each.
    found |= {bucket(name, graded(share), copy) for name, share in grades.items() for copy in range(4)}
    return sorted(found)


def metadata_features(source: str | None, lang: str | None, declared: int | None, raw: bytes) -> list[int]:
    lines = raw.count(b"\n") + 1
    facts = {
        "source": source, "lang": lang, "declared": None if declared is None else int(math.log2(max(1, declared))),
        "lines": int(2 * math.log2(lines)), "line": int(2 * math.log2(max(1, len(raw) / lines))),
    }
    return sorted({bucket(name, value) for name, value in facts.items()})


@dataclass(frozen=True)
class View:
    """Log-odds of good documents by feature, and without any."""

    weights: np.ndarray
    prior: float

    @staticmethod
    def of(counts: np.ndarray, totals: np.ndarray) -> View:
        """From documents by (class, feature) and by class."""
        share = (counts + 0.5) / (totals[:, None] + 1.0)
        return View(np.log(share[1] / share[0]), float(np.log((totals[1] + 1) / (totals[0] + 1))))

    def scores(self, features: pa.Array) -> np.ndarray:
        """Log-odds per document, tempered by the number of its features."""
        ends = np.cumsum(np.r_[0, self.weights[features.flatten().to_numpy()]])
        offsets = features.offsets.to_numpy() - features.offsets[0].as_py()
        sizes = np.diff(offsets)
        odds = self.prior + (ends[offsets[1:]] - ends[offsets[:-1]]) / np.sqrt(np.maximum(1, sizes))
        # Sums run over a whole batch, so their last digits depend on a document's neighbours; a score just at a
        # threshold must not.
        return np.round(odds, DIGITS)


def extract(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, declared: str) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = pa.schema([(v, pa.list_(pa.int32())) for v in VIEWS])

    def run(batch: pa.RecordBatch):
        texts = utf8(batch.column("text"))
        facts = zip(*(batch.column(n).to_pylist() for n in ("source", "lang", "declared")), texts)
        done = rows(schema, {"content": [content_features(t) for t in texts], "metadata": [metadata_features(*f) for f in facts]})
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *done.columns], names=["doc_id", *VIEWS])

    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"), F.col(declared).cast("long").alias("declared"),
    )
    return arrow_pass(named, run, f"doc_id {kind}, content array<int>, metadata array<int>")


def _counts(featured: DataFrame, models: dict[str, View] | None, sure: float) -> dict[str, View]:
    """Both views trained on the labelled documents, and on those of which the other view of ``models`` is sure."""
    limit = round(math.log(sure / (1 - sure)), DIGITS)

    def run(batches):
        sums = {v: np.zeros((2, BUCKETS + 1), np.int64) for v in VIEWS}
        for batch in batches:
            label = np.array([-1 if x is None else x for x in batch.column("label").to_pylist()], np.int64)
            for view, other in zip(VIEWS, reversed(VIEWS)):
                classes = label.copy()
                if models:
                    score = models[other].scores(batch.column(other))
                    classes = np.where(label >= 0, label, np.where(score >= limit, 1, np.where(score <= -limit, 0, -1)))
                classes[batch.column("fold").to_numpy() == 0] = -1
                features = batch.column(view)
                sizes = np.diff(features.offsets.to_numpy())
                each = np.repeat(classes, sizes)
                for c in (0, 1):
                    sums[view][c, :-1] += np.bincount(features.flatten().to_numpy()[each == c], minlength=BUCKETS)
                    sums[view][c, -1] += (classes == c).sum()
        for view, both in sums.items():
            for c in (0, 1):
                there = both[c].nonzero()[0]
                yield pa.RecordBatch.from_pydict(
                    {
                        "view": pa.array([view] * len(there), pa.string()),
                        "class": pa.array([c] * len(there), pa.int32()),
                        "feature": pa.array(there, pa.int32()),
                        "n": pa.array(both[c][there], pa.int64()),
                    }
                )

    counted = featured.mapInArrow(run, "view string, class int, feature int, n long")
    table = counted.groupBy("view", "class", "feature").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    for view in VIEWS:
        sums = np.zeros((2, BUCKETS + 1))
        own = np.array(table.column("view").to_pylist()) == view
        sums[table.column("class").to_numpy()[own], table.column("feature").to_numpy()[own]] = table.column("n").to_numpy()[own]
        out[view] = View.of(sums[:, :-1], sums[:, -1])
    return out


def platt(scores: np.ndarray, good: np.ndarray, all_: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log-odds of being good, by Newton steps with a slight pull to slope one."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        w = all_ * p * (1 - p)
        gradient = np.array([((good - all_ * p) * scores).sum() - 0.1 * (a - 1), (good - all_ * p).sum() - 0.01 * b])
        curve = np.array([[(w * scores * scores).sum() + 0.1, (w * scores).sum()], [(w * scores).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(curve, gradient)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return max(0.0, a), b


def _scored(featured: DataFrame, models: dict[str, View], kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            scores = [np.clip(models[v].scores(batch.column(v)), -REACH, REACH) for v in VIEWS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), batch.column("fold"), *map(pa.array, scores)],
                names=["doc_id", "label", "fold", *VIEWS],
            )

    return featured.mapInArrow(run, f"doc_id {kind}, label int, fold int, content double, metadata double")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    source: str = "source",
    lang: str = "lang",
    declared: str = "n_chars",
    rounds: int = 2,
    sure: float = 0.95,
    keep: float = 0.5,
) -> DataFrame:
    """(doc_id, content_score, metadata_score, quality_score, kept, held_out) for every row of ``docs``.

    Scores are probabilities that a document is good; ``kept`` is quality_score >= ``keep``. ``labels`` holds 0 or 1 per
    doc_id; of several labels the majority counts, and a tie or a null is no label. One in five labelled documents, by
    a hash of the id, is in no training but calibrates the views (``held_out``).

    * Null and empty texts are scored by what metadata they have, and as texts without words.
    * Null metadata is a value of its own. Rows that repeat an id are scored each for itself.
    * Without labels of both kinds nothing can be learned: all scores are 0.5, and all documents are kept.
    * Other columns are not read. An empty table gives an empty table.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    votes = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(label).alias("share"))
    given = votes.select("doc_id", F.when(F.col("share") > 0.5, 1).when(F.col("share") < 0.5, 0).cast("int").alias("label"))
    features = extract(docs, doc_id, text, source, lang, declared)
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5))
    featured = stored(
        features.join(given, "doc_id", "left").withColumn("fold", F.when(F.col("label").isNull(), -1).otherwise(fold).cast("int")),
        "features",
    )
    kinds = {r.label: r.n for r in featured.where("fold > 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    even = F.lit(0.5)
    if not (kinds.get(0) and kinds.get(1)):
        return featured.select(
            "doc_id", even.alias("content_score"), even.alias("metadata_score"), even.alias("quality_score"),
            F.lit(True).alias("kept"), (F.col("fold") == 0).alias("held_out"),
        )
    models = _counts(featured, None, sure)
    for _ in range(rounds):
        models = _counts(featured, models, sure)
    scored = _scored(featured, models, kind)
    grid = [F.round(F.col(v) / STEP).cast("int").alias(v) for v in VIEWS]
    cells = scored.where("fold = 0").select("label", *grid).groupBy(*VIEWS).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
    table = cells.toArrow()
    n, good = (table.column(c).to_numpy().astype(float) for c in ("n", "good"))
    fits = {v: platt(table.column(v).to_numpy() * STEP, good, n) for v in VIEWS}
    prior = math.log((good.sum() + 1) / (n.sum() - good.sum() + 1))
    odds = {v: F.col(v) * fits[v][0] + fits[v][1] for v in VIEWS}
    chance = lambda x: 1 / (1 + F.exp(-x))
    both = chance(odds["content"] + odds["metadata"] - prior)
    return scored.select(
        "doc_id", chance(odds["content"]).alias("content_score"), chance(odds["metadata"]).alias("metadata_score"),
        both.alias("quality_score"), (both >= keep).alias("kept"), (F.col("fold") == 0).alias("held_out"),
    )
