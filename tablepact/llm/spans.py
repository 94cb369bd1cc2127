"""Places of pattern matches in a text, by column functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums run within chunks of this many matches, then over the chunks, so that a text full of matches stays cheap.
CHUNK = 256


def _sums(numbers: Column) -> Column:
    """Running sums of a short array."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<bigint>)").alias("sums"))
    return F.aggregate(
        numbers,
        start,
        lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["sums"], F.array(s["total"] + x)).alias("sums")),
        lambda s: s["sums"],
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body or functions within it name it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of long."""

    def in_chunks(own: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(own, c * CHUNK + 1, CHUNK))

    def joined(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))
        ahead = F.slice(F.concat(F.array(F.lit(0).cast("long")), _sums(totals)), F.lit(1), F.size(chunks))
        return F.flatten(F.zip_with(chunks, ahead, lambda c, a: F.transform(_sums(c), lambda s: s + a)))

    return let(let(numbers, in_chunks), joined)


def code_points(text: Column) -> Column:
    return F.length(text).cast("long")


def placed(matches: Column, measure: Callable[[Column], Column] = code_points) -> Column:
    """Places of a struct of the matches ``found`` and the texts ``between`` them, as ``located`` gives them."""
    gaps = F.slice(matches["between"], F.lit(1), F.size(matches["found"]))
    ends = running_sums(F.zip_with(gaps, matches["found"], lambda g, m: measure(g) + measure(m)))
    after = F.slice(matches["between"], F.lit(2), F.size(matches["found"]))
    joined = F.arrays_zip(ends.alias("end"), matches["found"].alias("found"), gaps.alias("before"), after.alias("after"))
    return F.transform(
        joined,
        lambda j: F.struct(
            (j["end"] - measure(j["found"])).alias("start"), j["end"].alias("end"), j["found"].alias("found"),
            j["before"].alias("before"), j["after"].alias("after"),
        ),
    )


def located(text: Column, pattern: Column, measure: Callable[[Column], Column] = code_points) -> Column:
    """All leftmost matches that do not overlap: array of struct<start, end, found, before, after>.

    ``start`` and ``end`` are what ``measure`` gives for the text before, and with, the match; before and
    after are the texts up to the neighbouring matches. Java splits a text at the same places where it finds matches.
    """
    nothing = F.expr("cast(array() as array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>)")

    matches = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")
    )
    return let(matches, lambda t: F.when(F.size(t["found"]) > 0, placed(t, measure)).otherwise(nothing))
