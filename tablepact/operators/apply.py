"""Contracts applied to data: declared columns, in declared order, of declared types."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.errors import ContractError
from tablepact.functions.casts import cast_to
from tablepact.functions.columns import column, find_field
from tablepact.functions.text import snake_case
from tablepact.plans.contract import Contract, Field, text_type

PARSED_PREFIX = "__parsed_"


@dataclass(frozen=True)
class Staged:
    """A frame whose nested declared columns are structured, however they arrived.

    ``roots`` maps each declared top-level name to the physical column that holds it.
    """

    frame: DataFrame
    roots: dict[str, T.StructField]

    def leaf(self, path: tuple[str, ...]) -> tuple[Column, T.DataType] | None:
        """The value at ``path`` as it arrived, and its type; None where the frame has none."""
        held = self.roots.get(path[0])
        physical = []
        for position, name in enumerate(path):
            if position:
                held = find_field(held.dataType, name) if isinstance(held.dataType, T.StructType) else None
            if held is None:
                return None
            physical.append(held.name)
        return column(physical), held.dataType

    def typed(self, path: tuple[str, ...], data_type: T.DataType) -> Column:
        found = self.leaf(path)
        if found is None:
            return F.lit(None).cast(data_type)
        return cast_to(*found, data_type)


def stage(df: DataFrame, contract: Contract, paths: Collection[tuple[str, ...]] | None = None) -> Staged:
    """Bind the contract to the frame; parse nested columns that hold JSON text, once each.

    Given ``paths``, only columns and nested fields on one of them are parsed.
    """
    roots: dict[str, T.StructField] = {}
    absent = []
    for f in contract.fields:
        held = find_field(df.schema, f.name)
        if held is None:
            absent.extend([f.name] if f.required else [])
            continue
        needed = f.data_type if paths is None else _on_paths(f, paths)
        if needed is not None and _is_nested(f.data_type) and isinstance(held.dataType, T.StringType):
            shape = text_type(needed)
            df = _with_parsed(df, held.name, shape)
            held = T.StructField(PARSED_PREFIX + held.name, shape)
        roots[f.name] = held
    if absent:
        raise ContractError(f"{contract.name or 'contract'}: required columns missing: {', '.join(absent)}")
    return Staged(df, roots)


def _with_parsed(df: DataFrame, name: str, shape: T.DataType) -> DataFrame:
    """Add a column of JSON text in parsed form.

    It is the output of a generator of one row, because a filter on a plain column would be
    pushed below it and parse the text again for every rule it tests.
    """
    parsed = F.array(F.from_json(column([name]), shape))
    return df.select("*", F.explode_outer(parsed).alias(PARSED_PREFIX + name))


def _on_paths(f: Field, paths: Collection[tuple[str, ...]]) -> T.DataType | None:
    """The part of a field's type that lies on one of the paths."""
    if not any(path[: len(f.path)] == f.path for path in paths):
        return None
    if not isinstance(f.data_type, T.StructType):
        return f.data_type
    kept = [(c.name, _on_paths(c, paths)) for c in f.children]
    return T.StructType([T.StructField(name, kind) for name, kind in kept if kind is not None])


def _is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StructType, T.ArrayType, T.MapType))


def project(staged: Staged, contract: Contract) -> DataFrame:
    return staged.frame.select(*[_declared(staged, f) for f in contract.fields])


def _declared(staged: Staged, f: Field) -> Column:
    return staged.typed(f.path, f.data_type).alias(f.name, metadata=f.metadata)


def apply_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """The frame as the contract declares it.

    Declared columns in declared order, other columns dropped, values cast to the declared
    types (a bad value gives NULL), descriptions kept as column comments. Nested columns may
    arrive structured or as JSON text. An optional column the frame lacks is NULL; a required
    one is an error.
    """
    return project(stage(df, contract), contract)


def parse_payload(df: DataFrame, payload: str, contract: Contract) -> DataFrame:
    """Replace a JSON text column by a struct of the contract's shape and types."""
    shape = contract.text_schema
    parsed = _with_parsed(df, payload, shape)
    typed = cast_to(column([PARSED_PREFIX + payload]), shape, contract.schema)
    return parsed.select(*[typed.alias(c) if c == payload else column([c]) for c in df.columns])


def parse_rows(df: DataFrame, payload: str, contract: Contract, path: str) -> DataFrame:
    """One row per element of an array of objects in a JSON text column, with the element's fields as columns.

    ``path`` leads to the array, with dots. Elements are taken apart as text and cast afterwards, as plain columns, which
    keeps the casts in generated code. Rows without the array give none; the text column goes.
    """
    at = (payload, *path.split("."))
    shape, declared = contract.text_schema, contract.schema
    for name in path.split("."):
        held, wanted = find_field(shape, name), find_field(declared, name)
        if held is None:
            raise ContractError(f"{contract.name or 'contract'}: no field {path!r}")
        shape, declared = held.dataType, wanted.dataType
    if not isinstance(shape, T.ArrayType) or not isinstance(shape.elementType, T.StructType):
        raise ContractError(f"{contract.name or 'contract'}: {path!r} is not an array of objects")
    kept = [column([c]) for c in df.columns if c != payload]
    parsed = _with_parsed(df, payload, contract.text_schema)
    elements = parsed.select(*kept, F.explode(column([PARSED_PREFIX + at[0], *at[1:]])).alias(PARSED_PREFIX))
    fields = [
        cast_to(column([PARSED_PREFIX, f.name]), f.dataType, w.dataType).alias(w.name, metadata=w.metadata)
        for f, w in zip(shape.elementType.fields, declared.elementType.fields)
    ]
    return elements.select(*kept, *fields)


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename all columns, nested fields included, to snake_case identifiers."""
    renamed = _renamed(df.schema)
    if renamed == df.schema:
        return df
    flat = df.toDF(*renamed.names)
    nested = {
        new.name: column([new.name]).cast(new.dataType)
        for new, old in zip(renamed.fields, df.schema.fields)
        if new.dataType != old.dataType
    }
    return flat.withColumns(nested) if nested else flat


def _renamed(data_type: T.DataType) -> T.DataType:
    if isinstance(data_type, T.StructType):
        names = [snake_case(f.name) for f in data_type.fields]
        for new, f in zip(names, data_type.fields):
            if not new:
                raise ContractError(f"column {f.name!r} has no letter or digit to name it by")
            if names.count(new) > 1:
                clash = [g.name for g, n in zip(data_type.fields, names) if n == new]
                raise ContractError(f"columns {clash} would all be named {new!r}")
        return T.StructType(
            [
                T.StructField(new, _renamed(f.dataType), f.nullable, f.metadata)
                for new, f in zip(names, data_type.fields)
            ]
        )
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_renamed(data_type.elementType), data_type.containsNull)
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, _renamed(data_type.valueType), data_type.valueContainsNull)
    return data_type
