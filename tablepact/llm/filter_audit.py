"""What each filter of a corpus removes in every order of filters, by min-plus removal ranks.

A document's failures are a set of filters, its mask, and all that an order does to it follows from the mask. So documents
become counts per part and mask before anything is shuffled by part. The step that removes a mask is a min-plus
product: masks by filters (0 where the filter fails it, infinite where not) times filters by orders, the
inverse permutations, which hold each filter's position. Counts are scattered to their removal steps, and a mask
is redundant at every step of a failing filter after its own.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.shared import arrow_pass, rows, stored

#: Filters of ``audit_filters``, in the order of their bits; E, copies, is found by joining texts.
LETTERS = "ABCDE"

#: All orders of more filters would be too many to report.
MOST_FILTERS = 8

WORD = r"[^\x20\x09-\x0D]+"

#: Parts that are scattered at a time.
CHUNK = 64

REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: length, variety, capitals, odd characters."""

    def judged(words: Column) -> Column:
        short = F.size(words) < 50
        same = 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)
        loud = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text)
        odd = text.rlike(r"[#$%&*|]")
        return sum((F.when(fails, 1 << bit).otherwise(0) for bit, fails in enumerate((short, same, loud, odd))), F.lit(0))

    # One element, so that the words are taken from a text once.
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), judged)[0]


def removal_steps(letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders; the position of each filter in each order; the step (from 0) that removes each mask, or len(letters)."""
    count = len(letters)
    orders = np.array(list(permutations(range(count))), int).reshape(-1, count)
    position = np.argsort(orders, axis=1).T
    masks = (np.arange(1 << count)[:, None] >> np.arange(count)) & 1
    cost = np.where(masks == 1, 0, count)
    steps = np.full((1 << count, len(orders)), count)
    for bit in range(count):
        steps = np.minimum(steps, cost[:, bit, None] + position[bit])
    return ["".join(letters[f] for f in order) for order in orders], orders, steps


def audit_orders(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The report for ``counts`` (part, mask, n, good, toxic): a row per part, order and step; see ``audit_filters``.

    Bit i of a mask is set where filter ``letters[i]`` fails. Rows of the same part and mask add up; null parts are parts of their own.
    """
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters")
    summed = counts.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    listed = summed.groupBy("part").agg(*(F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")))
    names, orders, steps = removal_steps(letters)
    size, masks = len(letters), np.arange(1 << len(letters))
    failed = (masks[:, None, None] >> orders) & 1
    redundant = (failed * (steps[:, :, None] < np.arange(size))).astype(np.int64)
    schema = pa.schema([
        (n, pa.string() if n in ("part", "filter_order") else pa.int32() if n == "step" else pa.int64()) for n in (f.split()[0] for f in REPORT.split(", "))
    ])

    def scattered(weights: np.ndarray) -> np.ndarray:
        """Parts x orders x steps; what no step removes comes last."""
        out = np.zeros((len(weights), len(names), size + 1), np.int64)
        np.add.at(out, (np.arange(len(weights))[:, None, None], np.arange(len(names)), steps), weights[:, :, None])
        return out

    def report(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, CHUNK):
            some = batch.slice(start, CHUNK)
            given = {n: np.zeros((some.num_rows, len(masks)), np.int64) for n in ("n", "good", "toxic")}
            for i, own in enumerate(some.column("mask").to_pylist()):
                for n in given:
                    given[n][i, own] = some.column(n)[i].as_py()
            removed = scattered(given["n"])
            total = given["n"].sum(axis=1)
            unique = given["n"][:, 1 << np.arange(size)]
            shapley = np.zeros((some.num_rows, size), np.int64)
            for bit in range(size):
                shapley[:, bit] = (removed[:, :, :size] * (orders == bit)).sum(axis=(1, 2))
            shape = (some.num_rows, len(names), size)
            spread = lambda by_filter: by_filter[:, orders]
            columns = {
                "kept": total[:, None, None] - np.cumsum(removed[:, :, :size], axis=2),
                "removed": removed[:, :, :size],
                "redundant": (given["n"] @ redundant.reshape(len(masks), -1)).reshape(shape),
                "unique_fails": spread(unique),
                "good_lost": scattered(given["good"])[:, :, :size],
                "toxic_lost": scattered(given["toxic"])[:, :, :size],
                "shapley": spread(shapley),
            }
            each = np.repeat(np.arange(some.num_rows), len(names) * size)
            yield rows(schema, {
                "part": some.column("part").take(pa.array(each)),
                "filter_order": np.tile(np.repeat(names, size), some.num_rows).tolist(),
                "step": np.tile(np.arange(1, size + 1, dtype=np.int32), some.num_rows * len(names)),
                **{n: np.ascontiguousarray(c).reshape(-1) for n, c in columns.items()},
            })

    return arrow_pass(listed, report, REPORT)


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic) of ``docs`` under the five filters of ``audit_filters``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    judged = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
            text_mask(whole).alias("mask"),
            F.unhex(F.sha2(whole, 256)).alias("digest"),
        ),
        "judged",
    )
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # Rows without an id are neither copies nor labelled, and would meet under one key.
    nameless = judged.where("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    named = judged.where("doc_id is not null").groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("times"))
    labelled = (
        named.join(marks, named["doc_id"] == marks["of"], "left").drop("of").na.fill(False, ["good", "toxic"])
    )
    by_text = stored(
        labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "times")).alias("least")), "texts"
    )
    firsts = by_text.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    own = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.times")).otherwise(0)
    split = by_text.join(firsts, "digest").select("part", "mask", "good", "toxic", own.alias("own"), (F.col("n") - own).alias("copies"))
    pieces = F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")))
    counted = split.select("part", "good", "toxic", F.inline(pieces)).where("n > 0")
    chosen = lambda mark: F.when(F.col(mark), F.col("n")).otherwise(0).alias(mark)
    return counted.select("part", "mask", "n", chosen("good"), chosen("toxic")).unionAll(
        nameless.select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    )


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: what the step removes there, and what its filter is worth.

    Filters: A fewer than 50 words; B under 65 different words in 100; C over 5 capitals A-Z in 100 code points; D any of ``#$%&*|``;
    E the same text as a document of smaller id, in any part, removed or not. Columns: part, filter_order, step (from 1), kept after
    the step, removed by it, redundant (failing its filter, removed earlier), unique_fails (failing its filter alone), good_lost
    and toxic_lost (removed here, with quality or toxic 1 in ``labels``), shapley (what its filter removes, summed over all orders).

    * A part is a value of ``source``, null being the empty string. A null text is empty; an empty one fails A alone (and E if a smaller id has one).
    * Rows that share id and text are not copies of each other. A row with a null id is neither a copy nor labelled; others are not its copies.
    * Ids may be of any type with an order. Several labels of an id count as good or toxic if one of them is.
    * Equality of texts is that of their SHA-256, so very long texts are never shuffled; a text of any length is one row.
    * Other columns are not read. No documents give no rows; no labels give zeros.
    """
    return audit_orders(mask_counts(docs, labels, doc_id, text, source))
