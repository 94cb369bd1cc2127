"""Cast, check and store: valid rows to one place, the others to a quarantine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.errors import ContractError
from tablepact.functions.columns import column
from tablepact.operators.quality import ERRORS, accepted, bind, own_columns, split
from tablepact.plans.contract import Contract
from tablepact.sources.scratch import scratch_path
from tablepact.sources.tables import RUN, create_port_table, create_run_table, insert_by_name, insert_run


def enforce(
    df: DataFrame, contract: Contract, good: str, bad: str, mode: str = "overwrite", keep: bool = False
) -> None:
    """Write valid rows, cast to the contract, to ``good`` and the rest, as they came, to ``bad``.

    Both are Parquet paths. Quarantined rows keep their own columns plus ``_errors``.

    Each side is a map-only job of its own over the input; for files, the quarantine's scan
    can skip whatever the simple rules rule out, and nothing is copied.
    ``keep`` evaluates the input once instead, into a table in the shared folder from which both sides are
    written: right for input that is costly to compute, and needed for input that does not give the same rows twice.
    """
    if keep:
        valid, quarantine = stored_sides(df, contract, scratch_path(df.sparkSession, "sides"))
    else:
        valid, quarantine = accepted(df, contract), split(df, contract)[1]
    valid.write.mode(mode).parquet(good)
    quarantine.write.mode(mode).parquet(bad)


SIDE = "_side"
REJECTED = "_rejected"


def sided(df: DataFrame, contract: Contract) -> DataFrame:
    """Every row with the side it belongs to; the columns of the other side are NULL."""
    checked = bind(df, contract, whole=True)
    failed = F.coalesce(checked.any_failure, F.lit(False))
    side = F.when(failed, "bad").otherwise("good")
    typed = [
        F.when(~failed, checked.staged.typed(f.path, f.data_type)).alias(f.name, metadata=f.metadata)
        for f in contract.fields
    ]
    rejected = F.when(failed, F.struct(*own_columns(df))).alias(REJECTED)
    errors = F.when(failed, checked.failed).alias(ERRORS)
    return checked.staged.frame.select(*typed, rejected, errors, side.alias(SIDE))


def enforce_partitioned(df: DataFrame, contract: Contract, folder: str, mode: str = "overwrite") -> None:
    """As :func:`enforce`, in one pass over the input and one commit for both sides.

    Valid rows are below ``folder`` in ``_side=good``, with the contract's columns; the others
    in ``_side=bad``, with their own columns in the struct ``_rejected``, and ``_errors``. The
    columns of the other side are NULL. Tasks sort their rows by side before they write.
    """
    sided(df, contract).write.mode(mode).partitionBy(SIDE).parquet(folder)


def stored_sides(df: DataFrame, contract: Contract, folder: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantine, as :func:`enforce` writes them, read from one pass that is stored in ``folder``.

    The input is evaluated once and the two sides are committed together, so they agree whatever the input does and
    whichever executors are lost later.
    """
    rows = sided(df, contract)
    rows.write.mode("overwrite").partitionBy(SIDE).parquet(folder)
    held = df.sparkSession.read.schema(rows.schema).parquet(folder)
    good = held.where(F.col(SIDE) == "good").select(*[column([f.name]).alias(f.name, metadata=f.metadata) for f in contract.fields])
    own = [column([REJECTED, c]).alias(c) for c in df.columns if c != ERRORS]
    return good, held.where(F.col(SIDE) == "bad").select(*own, column([ERRORS]))


def enforce_tables(
    df: DataFrame, contract: Contract, good: str, bad: str, keep: bool = False, run: str | None = None, location: str | None = None
) -> None:
    """As :func:`enforce`, into the contract's table and a quarantine table.

    Both are created if need be, below ``location`` if that is given; the contract's has its types, comments and description.

    ``run`` names the run: both tables are then partitioned by the column ``_run``, and a run's partition in each is replaced as a
    whole. A run that is repeated, after a failure anywhere in between or without one, leaves each of its rows once, on one side. The input
    is evaluated once per attempt, and both sides are written from what is stored. Without ``run`` these are two appends: a
    repeat after a failure between them adds the valid rows again.
    """
    spark = df.sparkSession
    at = {name: f"{location.rstrip('/')}/{name}" if location else None for name in (good, bad)}
    if run is None:
        valid, quarantine = stored_sides(df, contract, scratch_path(spark, "sides")) if keep else (accepted(df, contract), split(df, contract)[1])
        create_port_table(spark, contract, good, at[good])
        insert_by_name(valid, good)
        quarantine.write.mode("append").options(**({"path": at[bad]} if location else {})).saveAsTable(bad)
        return
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,200}", run):
        raise ContractError(f"run {run!r} has other characters than letters, digits, '.', '_' and '-', or too many")
    taken = [c for c in (*df.columns, *contract.column_names) if c.lower() == RUN]
    if taken:
        raise ContractError(f"the column {taken[0]} names the run and can't be data")
    valid, quarantine = stored_sides(df, contract, scratch_path(spark, "sides"))
    create_run_table(spark, good, contract.schema, contract.description, at[good])
    create_run_table(spark, bad, quarantine.schema, f"rows that break the contract of {good}", at[bad])
    insert_run(valid, good, run)
    insert_run(quarantine, bad, run)
