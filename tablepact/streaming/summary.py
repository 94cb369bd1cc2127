"""Violation summaries of streams: running totals per check."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablepact.errors import ContractError
from tablepact.operators.joins import lookup
from tablepact.operators.ports import Port, try_patterns
from tablepact.operators.quality import SUMMARY_SCHEMA, summarise
from tablepact.plans.contract import Contract
from tablepact.plans.rules import UNREADABLE
from tablepact.streaming.enforce import BATCH, STREAM, each_batch, query_id

PORT = "port"


def counts_something(df: DataFrame, contract: Contract) -> bool:
    return bool(contract.checks) or UNREADABLE in df.columns


def summarise_stream(
    stream: DataFrame, contract: Contract, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Start counting rows and violations per check, over all that the stream has brought so far.

    The totals are one row of state, whatever the number of rows and checks, kept with the checkpoint. After each micro-batch they are stored
    whole in ``folder``, below the query's id and the batch id; a replayed batch overwrites itself, and a restart goes on from the
    state. :func:`read_summary` gives the last totals. A contract without checks has nothing to count and raises ContractError.
    """
    if not counts_something(stream, contract):
        raise ContractError(f"{contract.name or 'contract'}: no checks to count")

    def store(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{folder}/{STREAM}={query_id(totals)}/{BATCH}={batch_id}")

    return each_batch(summarise(stream, contract), store, checkpoint, trigger, "complete")


def summarise_port_streams(
    ports: Mapping[str, Port], folder: str, checkpoint: str, names: Iterable[str] | None = None, trigger: dict | None = None
) -> dict[str, StreamingQuery]:
    """Start :func:`summarise_stream` for every port, or those named: a query each, by port name.

    Ports without a contract, or without anything to check, have no query. An unknown name or a malformed pattern raises before any starts.
    """
    chosen = list(ports) if names is None else list(names)
    unknown = [name for name in chosen if name not in ports]
    if unknown:
        raise ContractError(f"no port named {', '.join(unknown)}")
    contracts = {name: ports[name].contract(name) for name in chosen}
    counted = {name: c for name, c in contracts.items() if c is not None and counts_something(ports[name].data, c)}
    for name, contract in counted.items():
        try_patterns(ports[name].data.sparkSession, contract)
    return {
        name: summarise_stream(ports[name].data, contract, f"{folder}/{PORT}={name}", f"{checkpoint}/{name}", trigger)
        for name, contract in counted.items()
    }


def read_summary(spark: SparkSession, folder: str, ports: bool = False) -> DataFrame:
    """The last totals of each query that has stored any in ``folder``: the columns of ``summarise``, and ``stream``.

    ``ports`` reads what :func:`summarise_port_streams` has stored, with the column ``port``.
    """
    keys = [*([PORT] if ports else []), STREAM]
    schema = f"{SUMMARY_SCHEMA}, {', '.join(f'{k} string' for k in keys)}, {BATCH} bigint"
    held = spark.read.schema(schema).parquet(folder)
    last = held.groupBy(*keys).agg(F.max(BATCH).alias("last"))
    return lookup(held, last, keys, "inner").where(F.col(BATCH) == F.col("last")).drop(BATCH, "last")
