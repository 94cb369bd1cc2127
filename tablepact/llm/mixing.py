"""Mixing sources to target weights, by Pareto order sampling.

A source's target is its share of the words of the mix, by weight, at most some whole number of its own size. The target holds every
document of the source a certain whole number of times; for what is left, documents have one
inclusion probability per source, and are ranked by Pareto's order: random odds divided by inclusion odds. The sample is the
documents of lowest rank, as many as fit the words that are left: its size is fixed in words, not in documents.

A document too long for the words left at its rank is passed over, and ranking goes on with those that fit, until the
target is met closely or nothing fits; last, the document whose size is nearest to the rest is taken if that comes nearer.
Random numbers are hashes of id and text, so reruns agree. Running totals are distributed: rows are
dealt by ranges of (source, rank), summed within a range and moved by the sums of the ranges before, so that no source
is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"

#: A source is ranked again while its sample misses more than this part of its target, and a document fits.
NEAR = 0.01


def running_total(df: DataFrame, key: str, order: Sequence[Column], value: Column) -> DataFrame:
    """``df`` with ``total``: the sum of ``value`` over the rows of the same key, up to this one in the order given.

    ``df`` has no column named range, value, total or before.
    """
    dealt = stored(df.withColumn("value", value).repartitionByRange(F.col(key), *order).withColumn("range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("range", key).agg(F.sum("value").alias("value"))
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range", key, F.coalesce(F.sum("value").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("total", F.sum("value").over(within))
    return summed.join(before, ["range", key]).withColumn("total", F.col("total") + F.col("before")).drop("range", "value", "before")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, copies: int) -> DataFrame:
    """(source, place, source_size, target) of each source in ``sizes`` (source, size).

    Sources in the order of their code points, null last, get ``weights`` in turn, over and over. They share ``share`` times all sizes by weight;
    a target stops at ``copies`` times its source's size, and what is over is shared again among the others. Each round is one sum over the
    sources. Sources may be many: they are numbered by ranges.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if not 0 <= share <= copies:
        raise ValueError(f"a share of {share} can't be made of {copies} copies of each document")
    summed = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    numbered = running_total(summed.withColumn("all", F.lit(0)), "all", [F.asc_nulls_last("source")], F.lit(1))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("total") - 1, F.lit(len(weights))).cast("int") + 1)
    sources = stored(numbered.select("source", (F.col("total") - 1).alias("place"), "source_size", turn.alias("weight")), "sources")
    most = copies * F.col("source_size")
    words = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = most <= level * F.col("weight")
        held, open_weight = sources.agg(F.sum(F.when(full, most).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        following = (words - held) / open_weight if open_weight else level
        if following <= level:
            break
        level = following
    return sources.select("source", "place", "source_size", F.least(most.cast("double"), level * F.col("weight")).alias("target"))


def _extras(ranked: DataFrame, gaps: DataFrame) -> list[DataFrame]:
    """Rows to take once more, in stored tables (row, place, size): a sample of ``ranked`` (row, place, size, odds) that fills ``gaps`` (place, gap, target)."""
    order = [F.col("odds"), F.col("size"), F.col("row")]
    taken: list[DataFrame] = []
    rest, gaps = ranked, stored(gaps, "gaps")
    while True:
        open_gaps = gaps.where(F.col("gap") > NEAR * F.col("target"))
        fitting = rest.join(open_gaps.select("place", "gap"), "place").where(F.col("size") <= F.col("gap"))
        totals = stored(running_total(fitting, "place", order, F.col("size")), "totals")
        chosen = totals.where(F.col("total") <= F.col("gap"))
        filled = stored(chosen.groupBy("place").agg(F.sum("size").alias("filled")), "filled")
        if filled.isEmpty():
            break
        taken.append(chosen.select("row", "place", "size"))
        # Whatever fits from here on comes later in the order than all that was chosen.
        rest = totals.where(F.col("total") > F.col("gap")).select("row", "place", "size", "odds")
        gaps = stored(gaps.join(filled, "place", "left").select("place", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap"), "target"), "gaps")
    left = ranked.select("row", "place", "size", "odds").join(_rows(taken), "row", "left_anti") if taken else ranked
    near = left.join(gaps.where("gap > 0").select("place", "gap"), "place").where(F.abs(F.col("gap") - F.col("size")) < F.col("gap"))
    last = near.groupBy("place").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), *order)).alias("best"))
    return [*taken, last.select("best.row", "place", "best.size")]


def _rows(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables).select("row")


def plan_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    copies: int = 2,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how many copies of each document the mix takes, one row per row of ``docs``.

    A size is a number of words, runs of other than blank characters. See ``source_targets`` for targets; the words taken of a source usually miss its target by none or a few
    words, and by more than ``NEAR`` of it only where every document left is too long to bring them nearer. No document has more than ``copies`` copies; taken is copies times size.

    * A null text has size 0, as one without words has; such documents take the certain copies of their source, and are never sampled. A null source is a source.
    * A source of size 0 has target 0 and no copies.
    * Repeated rows are documents of their own: equal ones have equal random numbers, and which of them is taken shows in no result.
    * Ids of any type will do, null too: they only enter the random numbers, with the texts. Very long texts count as any others.
    * Other columns are not read. An empty table gives an empty table.
    """
    low = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 53))
    sized = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            ((low + 0.5) / float(1 << 53)).alias("uniform"),
        ),
        "sizes",
    )
    targets = stored(source_targets(sized, weights, share, copies), "targets")
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    named = targets.withColumn("certain", certain).withColumn("gap", F.col("target") - F.col("certain") * F.col("source_size")).withColumnRenamed("source", "name")
    placed = stored(sized.join(named, sized["source"].eqNullSafe(named["name"]), "left").drop("name"), "placed")
    chance = F.col("gap") / F.col("source_size")
    odds = F.col("uniform") / (1 - F.col("uniform")) / (chance / (1 - chance))
    ranked = placed.where("gap > 0 and size > 0").select("row", "place", "size", odds.alias("odds"))
    extra = _rows(_extras(ranked, named.where("gap > 0").select("place", "gap", "target"))).withColumn("extra", F.lit(1))
    number = (F.col("certain") + F.coalesce("extra", F.lit(0))).cast("int")
    return placed.join(extra, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", number.alias("copies"), (number * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``plan_mix`` takes it, with all its columns; same settings and rules."""
    number = next(n for n in ("row", *(f"row{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    keyed = F.struct(F.col(number).alias("row"), F.col(doc_id).alias("doc_id"))
    plan = plan_mix(numbered.select(keyed.alias("key"), F.col(text).alias("text"), F.col(source).alias("source")), "key", "text", "source", **settings)
    times = plan.where("copies > 0").select(F.col("doc_id.row").alias(number), F.array_repeat(F.lit(0), F.col("copies")).alias("times"))
    held = numbered.select(number, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
    return held.join(times, number).select("document", F.explode("times")).select("document.*")
