"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A query over the tables in a folder, and SQL with the same result (None: rows only)."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks of a shuffle.

    For tables whose rows become far more text and work than their bytes in a file: few bytes, or one row group, are read by few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class Source:
    """Columns derived from one whole table, by expressions both Spark and the SQL side read alike."""

    table: str
    columns: tuple[str, ...]

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, self.table).selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(self.columns)} FROM {self.table}"


def source(table_name: str, *columns: str) -> Source:
    return Source(table_name, columns)


def summary_sql(origin: str, checks: list[tuple[str, str, str]], first: str = "") -> str:
    """Violation summary of ``origin``; checks are (rule, column, condition that breaks it)."""
    parts = [
        f"""SELECT {first}{number} AS check_no, '{rule}' AS "check", '{column}' AS "column",
        count(*) AS "rows", count(*) FILTER (WHERE {broken}) AS violations,
        CAST(count(*) FILTER (WHERE {broken}) AS DOUBLE) / count(*) AS rate FROM ({origin}) AS origin"""
        for number, (rule, column, broken) in enumerate(checks, 1)
    ]
    return "\nUNION ALL\n".join(parts)
