"""Contract enforcement on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablepact.operators.enforce import enforce_tables, stored_sides
from tablepact.plans.contract import Contract

STREAM, BATCH = "stream", "batch_id"

# Fixed value: where Spark tells the function of a micro-batch which query runs it.
QUERY_ID = "sql.streaming.queryId"

#: Where, below the checkpoint, the last micro-batch is kept until both of its sides are written.
SIDES = "sides"


def query_id(batch: DataFrame) -> str:
    """The id of the query a micro-batch belongs to: its checkpoint holds it, so it outlives restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)


def each_batch(
    stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None, mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def enforce_stream(
    stream: DataFrame,
    contract: Contract,
    good: str,
    bad: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start enforcing the contract on a stream of rows.

    Every micro-batch is split in two below ``good`` and ``bad``, each in a folder of the
    query's id, which its checkpoint holds, and its batch id. A batch replayed after a failure has
    both again and overwrites its folders, so no row is stored twice; a query with a new checkpoint counts
    batches anew, but in folders of its own. Reading ``good`` back yields the columns ``stream`` and ``batch_id``.
    ``trigger`` defaults to working off what is there and stopping.

    A batch is evaluated once: one pass stores both sides, in one commit, below the checkpoint, and they are copied from there. So
    the sides agree whatever the stream carries upstream and whichever executors are lost, and no executor keeps anything.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        below = f"{STREAM}={query_id(batch)}/{BATCH}={batch_id}"
        valid, quarantine = stored_sides(batch, contract, f"{checkpoint.rstrip('/')}/{SIDES}")
        valid.write.mode("overwrite").parquet(f"{good}/{below}")
        quarantine.write.mode("overwrite").parquet(f"{bad}/{below}")

    return each_batch(stream, store, checkpoint, trigger)


def enforce_stream_tables(
    stream: DataFrame,
    contract: Contract,
    good: str,
    bad: str,
    checkpoint: str,
    trigger: dict | None = None,
    location: str | None = None,
) -> StreamingQuery:
    """As :func:`enforce_stream`, into the contract's table and a quarantine table (see :func:`enforce_tables`).

    Every micro-batch is a run of its own, named by the query's id and its batch id: a replayed batch replaces its partitions in both tables.
    Batches are written by a session of the query's own; one that has read the tables before refreshes them to see replaced partitions.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        enforce_tables(batch, contract, good, bad, run=f"{query_id(batch)}-{batch_id}", location=location)

    return each_batch(stream, store, checkpoint, trigger)
