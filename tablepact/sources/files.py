"""Ports held as files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.errors import ContractError
from tablepact.functions.columns import find_field
from tablepact.operators.apply import apply_contract
from tablepact.plans.contract import Contract
from tablepact.plans.rules import UNREADABLE

SELF_DESCRIBING = ("parquet", "orc")
TEXT_FORMATS = ("json", "csv")


def read_raw(spark: SparkSession, contract: Contract, location: str, fmt: str, **options: str) -> DataFrame:
    """The port's rows before any cast, ready for checks.

    JSON and CSV are read as text in the declared shape, so no type is inferred and no bad
    value can end the job; a line that is no JSON is kept as it is in ``_unreadable``, which check sets
    report as ``is_readable``; in CSV, nested columns hold JSON text, and columns go by the names
    in the header unless ``header="false"`` says there is none. Parquet and ORC carry their
    own types; declared columns are read even where the file that shows the types lacks them.
    """
    reader = spark.read.options(**options)
    if fmt in SELF_DESCRIBING:
        held = reader.format(fmt).load(location).schema
        absent = [f for f in contract.schema.fields if find_field(held, f.name) is None]
        return reader.format(fmt).schema(T.StructType([*held.fields, *absent])).load(location)
    if fmt == "json":
        whole = str(options.get("multiLine", "false")).lower() == "true"
        lines = reader.text(location, wholetext=whole).where(F.col("value").rlike(r"\S"))
        return parsed_records(lines, "value", contract, options, outer=True)
    if fmt == "csv":
        reader = spark.read.options(**{**CSV_OPTIONS, **options})
        if options.get("header", "true") == "false":
            reader = reader.schema(flat_text_schema(contract))
        return reader.csv(location)
    raise ContractError(f"format {fmt!r} is not one of {', '.join((*SELF_DESCRIBING, *TEXT_FORMATS))}")


def parsed_records(
    df: DataFrame, payload: str, contract: Contract, options: Mapping[str, str] | None = None, outer: bool = False
) -> DataFrame:
    """The JSON records in a text or binary column, in the contract's shape as text, and the frame's other columns.

    Works on streams as on tables: a port on a message bus is read so, and the check set is that of any other port.

    A record that cannot be read is one row with its text in ``_unreadable``; so is one of which a part does not have the declared
    shape, with the parts that have. A JSON array is a record per element. A missing text is a record of NULLs. Where the frame's other
    columns are named like declared ones, the record's values count, and with ``outer`` the frame's, as for directories of files. The records leave a generator, so that a filter on them never repeats the parse.
    """
    shape = T.StructType([*contract.text_schema.fields, T.StructField(UNREADABLE, T.StringType())])
    settings = {k: v for k, v in (options or {}).items() if k.lower() not in ("mode", "columnnameofcorruptrecord")}
    text = F.col(f"`{payload}`").cast("string")
    one = F.from_json(text, shape, {**settings, "columnNameOfCorruptRecord": UNREADABLE})
    lost = F.from_json(F.to_json(F.struct(text.alias(UNREADABLE))), shape)
    many = F.coalesce(F.from_json(text, T.ArrayType(shape), settings), F.array(lost))
    records = F.when(text.rlike(r"^\s*\["), many).otherwise(F.array(one))
    declared = {f.name.lower() for f in shape.fields}
    own = {c.lower(): c for c in df.columns if c != payload and (outer or c.lower() not in declared)}
    rows = df.select(*[F.col(f"`{c}`") for c in own.values()], F.explode(records).alias(RECORD))
    record = [F.col(f"{RECORD}.`{f.name}`") for f in shape.fields if f.name.lower() not in own]
    return rows.select(*record, *[F.col(f"`{c}`") for c in own.values()])


RECORD = "__record"

# Quotes inside quoted values are doubled; files whose headers differ are an error.
CSV_OPTIONS = {"header": "true", "escape": '"', "inferSchema": "false", "enforceSchema": "false"}


def flat_text_schema(contract: Contract) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in contract.column_names])


def read_port(spark: SparkSession, contract: Contract, location: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A port's data as its contract declares it."""
    return apply_contract(read_raw(spark, contract, location, fmt, **options), contract)
