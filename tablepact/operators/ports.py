"""One action over several ports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.errors import ContractError, PortErrors
from tablepact.functions.columns import column
from tablepact.operators.apply import apply_contract
from tablepact.operators.quality import summarise
from tablepact.plans.contract import Contract

PORT = "port"


@dataclass(frozen=True)
class Port:
    """A dataset and what it promises: a compiled contract, a JSON Schema dict, or nothing."""

    data: DataFrame
    schema: Contract | Mapping[str, Any] | None = None

    def contract(self, name: str) -> Contract | None:
        if self.schema is None or isinstance(self.schema, Contract):
            return self.schema
        return Contract.from_schema(self.schema, name)


def run_ports(
    ports: Mapping[str, Port],
    names: Iterable[str] | None = None,
    action: Callable[[DataFrame, Contract], DataFrame] = apply_contract,
) -> DataFrame:
    """Run ``action`` on all ports, or the named ones, and stack the results under ``port``.

    An unknown name fails at once and a port without schema is skipped. Errors of single
    ports, malformed patterns among them, are collected and raised together before any row is read. Columns a
    port lacks are NULL; a column whose type differs between ports is text in the stack, nested ones as JSON.
    """
    chosen = list(ports) if names is None else [n.strip() for n in names if n.strip()]
    for name in chosen:
        if name not in ports:
            raise ContractError(f"port {name!r} not found")
    results: list[DataFrame] = []
    errors: dict[str, Exception] = {}
    for name in chosen:
        try:
            contract = ports[name].contract(name)
            if contract is not None:
                try_patterns(ports[name].data.sparkSession, contract)
                result = action(ports[name].data, contract)
                results.append(result.select(F.lit(name).alias(PORT), "*"))
        except (ContractError, PySparkException) as err:
            errors[name] = err
    if errors:
        raise PortErrors(errors)
    if not results:
        raise ContractError("no ports selected")
    return stacked(agreeing(results))


def try_patterns(spark: SparkSession, contract: Contract) -> None:
    """Raise for a pattern Spark cannot read. The optimizer works these out; no job runs."""
    for check in contract.checks:
        if check.rule == "regex_match":
            try:
                spark.sql("SELECT 1").select(F.lit("").rlike(check.args[0])).collect()
            except PySparkException as err:
                raise ContractError(f"{check.column}: pattern {check.args[0]!r} is malformed") from err


def agreeing(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """The frames with columns as text where their types differ."""
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for field in frame.schema:
            kinds.setdefault(field.name.lower(), set()).add(field.dataType.simpleString())

    def shown(field: T.StructField) -> Column:
        value = column([field.name])
        if len(kinds[field.name.lower()]) == 1:
            return value
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        return (F.to_json(value) if nested else value.cast("string")).alias(field.name)

    return [frame.select(*map(shown, frame.schema)) for frame in frames]


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of the frames; paired up evenly, so that very many ports stay quick to plan."""
    if len(frames) == 1:
        return frames[0]
    middle = len(frames) // 2
    return stacked(frames[:middle]).unionByName(stacked(frames[middle:]), allowMissingColumns=True)


def summarise_ports(ports: Mapping[str, Port], names: Iterable[str] | None = None) -> DataFrame:
    """The violation summary of every port, stacked."""
    return run_ports(ports, names, summarise)
