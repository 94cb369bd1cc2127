"""What the operators of this subpackage share: tables, stored steps, Arrow passes, link components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.sources.scratch import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marker(docs: DataFrame, wish: str = "_") -> str:
    """A column name that ``docs`` does not have, in any case of letters."""
    held = {c.lower() for c in docs.columns}
    while wish.lower() in held:
        wish += "_"
    return wish


def whole_numbers(docs: DataFrame, column: str) -> str:
    """The type of a column of ids; ValueError if they are no whole numbers."""
    kind = docs.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{column} must hold whole numbers, not {kind}")
    return kind


def arrow_pass(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``function`` to every Arrow batch of ``df``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null is empty."""
    return [b"" if text is None else text for text in column.cast(pa.binary()).to_pylist()]


def rows(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    """A batch with the fields of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in schema for c in [columns[f.name]]], schema=schema
    )


def count_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that a link names; the component is the smallest id reachable.

    ``links`` has the columns a and b. Large-star and small-star steps alternate until the links
    no longer change. Every step is one aggregate for the smallest neighbour and one join on the
    node, which adaptive execution splits for nodes of many links; each round is a stored table.
    """
    current = stored(_ordered(links), "links")
    state = _fingerprint(current)
    while True:
        following = stored(_small_star(_large_star(current)), "links")
        reached = _fingerprint(following)
        if reached == state:
            break
        current, state = following, reached
    smallest = following.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return smallest.unionAll(following.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(a, 65521))")).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _ordered(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b"))


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return _ordered(moved.unionAll(least.select(F.col("m").alias("a"), "b")))
