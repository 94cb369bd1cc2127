"""Ports held as catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablepact.errors import ContractError
from tablepact.operators.apply import apply_contract
from tablepact.plans.contract import Contract


def create_port_table(spark: SparkSession, contract: Contract, table: str, path: str | None = None) -> None:
    """Create the contract's table unless it exists: types, column comments, table comment.

    Declared nullability is not part of the table: Parquet tables do not enforce it, the
    not-null check does.
    """
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(
            table, path=path, source="parquet", schema=contract.schema, description=contract.description
        )


#: Partition column of tables that are filled run by run.
RUN = "_run"


def create_run_table(spark: SparkSession, table: str, schema: T.StructType, description: str = "", path: str | None = None) -> None:
    """Create a table of these columns, partitioned by run, unless it exists; column comments are kept."""
    if spark.catalog.tableExists(table):
        return
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(RUN, T.StringType())]))
    empty.write.options(**({"path": path} if path else {})).partitionBy(RUN).format("parquet").saveAsTable(table)
    if description:
        text = description.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"COMMENT ON TABLE {table} IS '{text}'")


def insert_run(rows: DataFrame, table: str, run: str) -> None:
    """Replace what a run has in the table, column by name; other runs stay. No rows leave none."""
    spark = rows.sparkSession
    if RUN not in [c.name for c in spark.catalog.listColumns(table) if c.isPartition]:
        raise ContractError(f"table {table} is not partitioned by {RUN}, so runs can't be told apart")
    fitting = fitted(rows, table, spark.table(table).drop(RUN).schema)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({RUN} = '{run}') SELECT * FROM {{fitting}}", fitting=fitting)


def write_port(
    df: DataFrame, contract: Contract, table: str, path: str | None = None, overwrite: bool = False
) -> None:
    """Insert the frame, cast to the contract, into the contract's table, column by name."""
    create_port_table(df.sparkSession, contract, table, path)
    insert_by_name(apply_contract(df, contract), table, overwrite)


def insert_by_name(typed: DataFrame, table: str, overwrite: bool = False) -> None:
    """Insert into a table that has the same columns with the same types, in whatever order."""
    fitted(typed, table, typed.sparkSession.table(table).schema).write.insertInto(table, overwrite=overwrite)


def fitted(typed: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """The frame in the order of the table's columns, which must be the same with the same types."""
    held = {f.name.lower(): f for f in schema}
    given = {f.name.lower(): f for f in typed.schema}
    if held.keys() != given.keys():
        odd = ", ".join(sorted(held.keys() ^ given.keys()))
        raise ContractError(f"table {table} and the contract differ in the columns {odd}")
    for name, field in held.items():
        wanted = given[name].dataType
        if field.dataType.simpleString() != wanted.simpleString():
            raise ContractError(
                f"{name} is {field.dataType.simpleString()} in table {table} and {wanted.simpleString()} in the contract"
            )
    return typed.select(*[typed[f"`{given[name].name}`"] for name in held])
