"""Data contracts applied to Spark DataFrames, tables and streams."""

from tablepact.errors import ContractError, PortErrors
from tablepact.functions.checks import CHECKS, register_check
from tablepact.operators.apply import apply_contract, parse_payload, parse_rows, snake_case_columns
from tablepact.operators.catalog import (
    blocked_connections,
    connection_ports,
    connection_usage,
    connection_variables,
    dangling_references,
    describe_connection,
    duplicate_names,
    endpoint_users,
    port_listing,
    removable_connections,
)
from tablepact.operators.closure import schema_closure
from tablepact.operators.enforce import enforce, enforce_partitioned, enforce_tables
from tablepact.operators.ports import Port, run_ports, summarise_ports
from tablepact.operators.quality import annotate, split, summarise, violations
from tablepact.operators.references import broken_references, reached_files, schema_edges, schema_uses
from tablepact.plans.contract import Contract, Field, contracts_of
from tablepact.plans.rules import Check
from tablepact.sources.files import parsed_records, read_port, read_raw
from tablepact.sources.specs import Catalog, field_catalog, load_specs, parse_catalog, read_spec
from tablepact.sources.tables import create_port_table, write_port
from tablepact.streaming.enforce import enforce_stream, enforce_stream_tables
from tablepact.streaming.summary import read_summary, summarise_port_streams, summarise_stream

__all__ = [
    "CHECKS",
    "Catalog",
    "Check",
    "Contract",
    "ContractError",
    "Field",
    "Port",
    "PortErrors",
    "annotate",
    "apply_contract",
    "blocked_connections",
    "broken_references",
    "connection_ports",
    "connection_usage",
    "connection_variables",
    "contracts_of",
    "create_port_table",
    "dangling_references",
    "describe_connection",
    "duplicate_names",
    "endpoint_users",
    "enforce",
    "enforce_partitioned",
    "enforce_stream",
    "enforce_stream_tables",
    "enforce_tables",
    "field_catalog",
    "load_specs",
    "parse_catalog",
    "parse_payload",
    "parse_rows",
    "parsed_records",
    "port_listing",
    "reached_files",
    "read_port",
    "read_raw",
    "read_spec",
    "read_summary",
    "register_check",
    "removable_connections",
    "run_ports",
    "schema_closure",
    "schema_edges",
    "schema_uses",
    "snake_case_columns",
    "split",
    "summarise",
    "summarise_port_streams",
    "summarise_ports",
    "summarise_stream",
    "violations",
    "write_port",
]
