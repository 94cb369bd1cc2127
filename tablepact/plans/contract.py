"""Contracts: a JSON Schema compiled to Spark types and an ordered list of checks.

Compilation is driver-side and touches metadata only. The result holds what the
operators need to build one DataFrame plan: the declared columns in order, their
Spark types with comments, and the checks.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from tablepact.errors import ContractError
from tablepact.plans.rules import CONSTRAINT_KEYWORDS, Check, checks_for, sql_check

# Formats that decide the Spark type ahead of the declared type.
TYPE_BY_FORMAT = {
    "date": T.DateType(),
    "date-time": T.TimestampType(),
    "uuid": T.StringType(),
}

# JSON Schema type to Spark type; anything else is a string.
TYPE_BY_NAME = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
}

# Where a local reference may point.
REF_PREFIXES = ("#/$defs/", "#/definitions/", "#/components/schemas/")

COMPOSITION_KEYWORDS = ("allOf", "anyOf", "oneOf")


@dataclass(frozen=True)
class Field:
    """One declared property, placed by its path from the root."""

    path: tuple[str, ...]
    data_type: T.DataType
    required: bool
    description: str = ""
    constraints: Mapping[str, Any] = field(default_factory=dict)
    children: tuple[Field, ...] = ()

    @property
    def name(self) -> str:
        return self.path[-1]

    @property
    def dotted(self) -> str:
        return ".".join(self.path)

    @property
    def metadata(self) -> dict[str, str]:
        return {"comment": self.description} if self.description else {}

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.data_type, not self.required, self.metadata)


@dataclass(frozen=True)
class Contract:
    """A compiled contract. Build one with :meth:`from_schema` or :meth:`from_json`."""

    name: str
    fields: tuple[Field, ...]
    checks: tuple[Check, ...]
    description: str = ""

    @classmethod
    def from_schema(
        cls,
        schema: Mapping[str, Any],
        name: str = "",
        components: Mapping[str, Any] | None = None,
        files: Mapping[str, Any] | None = None,
    ) -> Contract:
        """Compile a JSON Schema given as a dict; ``components`` are shared schemas by name.

        ``files`` are further schemas by path. A reference to a path is relative to the file that makes
        it, and local references inside a file are to that file's definitions.
        """
        try:
            return _Compiler(components or {}, files).compile(schema, name)
        except (AttributeError, TypeError) as err:
            raise ContractError(f"{name or 'the schema'} is malformed: {err}") from err

    @classmethod
    def from_json(cls, text: str, name: str = "", components: Mapping[str, Any] | None = None) -> Contract:
        """Compile a JSON Schema given as JSON text."""
        return cls.from_schema(json.loads(text), name, components)

    @property
    def schema(self) -> T.StructType:
        """Declared Spark schema: column order, types, nullability and comments."""
        return T.StructType([f.struct_field() for f in self.fields])

    @property
    def text_schema(self) -> T.StructType:
        """Same shape with every leaf as text; how JSON and CSV input is first read."""
        return text_type(self.schema)

    @property
    def column_names(self) -> list[str]:
        return [f.name for f in self.fields]

    def leaves(self) -> list[Field]:
        """Every field that is not a nested object, depth first, in declared order.

        Elements of arrays of objects follow their array, with ``[]`` after its name.
        """
        found: list[Field] = []

        def walk(fields: tuple[Field, ...]) -> None:
            for f in fields:
                if not isinstance(f.data_type, T.StructType):
                    found.append(f)
                walk(f.children)

        walk(self.fields)
        return found

    def with_check(self, rule: str, column: str, *args: Any, message: str = "") -> Contract:
        """Add a rule by its registered name to a leaf, given by its dotted path."""
        leaf = next((f for f in self.leaves() if f.dotted == column), None)
        if leaf is None:
            raise ContractError(f"{self.name or 'contract'}: no field {column!r} to check")
        check = Check(rule, leaf.path, args, message or f"{column} must pass {rule}", leaf.required, leaf.data_type)
        return replace(self, checks=(*self.checks, check))

    def with_expression(self, expression: str, message: str = "") -> Contract:
        """Add a boolean Spark SQL expression over the columns of the checked frame."""
        return replace(self, checks=(*self.checks, sql_check(expression, message)))


def contracts_of(spec: Mapping[str, Any]) -> dict[str, Contract | None]:
    """The contract of each port of one spec, by port name; None where a port has no schema."""
    components = (spec.get("components") or {}).get("schemas") or {}
    schemas = {name: (port or {}).get("schema") for name, port in (spec.get("ports") or {}).items()}
    return {
        name: None if schema is None else Contract.from_schema(schema, name, components)
        for name, schema in schemas.items()
    }


def text_type(data_type: T.DataType) -> T.DataType:
    """The type with each leaf replaced by string, structure kept."""
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, text_type(f.dataType)) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(text_type(data_type.elementType))
    if isinstance(data_type, T.MapType):
        return T.MapType(T.StringType(), text_type(data_type.valueType))
    return T.StringType()


def as_schema(node: Any) -> Mapping[str, Any]:
    """Boolean schemas (``true``/``false``) declare nothing."""
    return node if isinstance(node, Mapping) else {}


def type_name(node: Mapping[str, Any]) -> str:
    declared = node.get("type")
    return declared if isinstance(declared, str) else ""


def is_object(node: Mapping[str, Any]) -> bool:
    return type_name(node) == "object" or (not type_name(node) and bool(node.get("properties")))


# References on the way to one field, and checks of one contract, beyond which something is wrong with
# the schema: no plan could hold it.
MOST_REFERENCES, MOST_CHECKS = 200, 5000

FILE_MARK = "file "


def _file_of(trail: tuple[str, ...]) -> str | None:
    """The file that the reference being expanded stands in; None for the contract itself."""
    marks = [t for t in trail if t.startswith(FILE_MARK)]
    return marks[-1][len(FILE_MARK) :].partition("#")[0] if marks else None


class _Compiler:
    """Resolves one root schema. Names on ``trail`` are the references being expanded."""

    def __init__(self, components: Mapping[str, Any], files: Mapping[str, Any] | None = None):
        self.components = components
        self.files = files
        self.fields = 0
        self.root: Mapping[str, Any] = {}

    def compile(self, schema: Mapping[str, Any], name: str) -> Contract:
        self.root = as_schema(schema)
        node, trail = self.follow(self.root, ())
        if node is not self.root:
            local = {k: {**(self.root.get(k) or {}), **(node.get(k) or {})} for k in ("$defs", "definitions")}
            self.root = {**node, **local}
        self.refuse_composition(node, name or "the root schema")
        if type_name(node) not in ("", "object"):
            raise ContractError(f"{name or 'the root schema'} must be an object, not {node['type']!r}")
        fields = self.fields_of(node, (), trail)
        checks = [check for f in fields for check in self.checks_of(f)]
        return Contract(name, fields, tuple(checks), str(node.get("description", "")))

    def fields_of(self, node: Mapping[str, Any], parent: tuple[str, ...], trail: tuple[str, ...]) -> tuple[Field, ...]:
        required = set(node.get("required") or ())
        return tuple(
            self.field(as_schema(prop), (*parent, name), name in required, trail)
            for name, prop in (node.get("properties") or {}).items()
        )

    def field(self, prop: Mapping[str, Any], path: tuple[str, ...], required: bool, trail: tuple[str, ...]) -> Field:
        self.fields += 1
        if self.fields > MOST_CHECKS:
            raise ContractError(f"{path[0]}: the schema expands to more than {MOST_CHECKS} fields")
        description = str(prop.get("description", ""))
        node, trail = self.follow(prop, trail)
        data_type, children = self.resolve(node, path, trail)
        constraints = {k: node[k] for k in CONSTRAINT_KEYWORDS if k in node}
        return Field(path, data_type, required, description, constraints, children)

    def resolve(
        self, node: Mapping[str, Any], path: tuple[str, ...], trail: tuple[str, ...]
    ) -> tuple[T.DataType, tuple[Field, ...]]:
        if type_name(node) == "array":
            items = node.get("items")
            if items is None or isinstance(items, list):
                return T.ArrayType(T.StringType()), ()
            element, trail = self.follow(as_schema(items), trail)
            element_path = (*path[:-1], path[-1] + "[]")
            element_type, children = self.resolve(element, element_path, trail)
            return T.ArrayType(element_type), children
        self.refuse_composition(node, ".".join(path))
        if is_object(node):
            children = self.fields_of(node, path, trail)
            if not children:
                # Open objects: an empty struct cannot be stored, a text map can.
                return T.MapType(T.StringType(), T.StringType()), ()
            return T.StructType([c.struct_field() for c in children]), children
        by_format = TYPE_BY_FORMAT.get(node.get("format"))
        return by_format or TYPE_BY_NAME.get(type_name(node), T.StringType()), ()

    def refuse_composition(self, node: Mapping[str, Any], where: str) -> None:
        used = [k for k in COMPOSITION_KEYWORDS if node.get(k)]
        if used and (is_object(node) or not type_name(node)):
            raise ContractError(f"{where}: {', '.join(used)} cannot be turned into columns")

    def follow(self, node: Mapping[str, Any], trail: tuple[str, ...]) -> tuple[Mapping[str, Any], tuple[str, ...]]:
        """Chase ``$ref`` until a schema of its own; a reference wins over its siblings."""
        while node.get("$ref"):
            ref = node["$ref"]
            prefix = next((p for p in REF_PREFIXES if ref.startswith(p)), None)
            if prefix is None and self.files is not None and not ref.startswith("#"):
                node, trail = self.from_file(ref, trail)
                continue
            if prefix is None:
                raise ContractError(f"reference {ref!r} does not point inside the contract")
            name = ref[len(prefix) :]
            if name in trail:
                cycle = " -> ".join((*trail[trail.index(name) :], name))
                raise ContractError(f"schema reference cycle: {cycle}")
            node, trail = as_schema(self.lookup(name, prefix, trail)), (*trail, name)
            if len(trail) > MOST_REFERENCES:
                raise ContractError(f"more than {MOST_REFERENCES} references lead to {name!r}")
        return node, trail

    def from_file(self, ref: str, trail: tuple[str, ...]) -> tuple[Mapping[str, Any], tuple[str, ...]]:
        """The schema a file holds, or one of its definitions; paths are relative to the file that names them."""
        path, _, inside = ref.partition("#")
        path = posixpath.normpath(posixpath.join(posixpath.dirname(_file_of(trail) or ""), path))
        if path not in self.files:
            raise ContractError(f"file {path!r} not found")
        mark = f"{FILE_MARK}{path}#{inside}"
        if mark in trail:
            raise ContractError(f"schema reference cycle: {' -> '.join((*trail[trail.index(mark) :], mark))}")
        node: Any = self.files[path]
        if not isinstance(node, (Mapping, bool)):
            raise ContractError(f"file {path!r} holds no schema")
        for part in [p for p in inside.split("/") if p]:
            node = as_schema(node).get(part)
        if node is None:
            raise ContractError(f"{ref!r} is not in file {path!r}")
        return as_schema(node), (*trail, mark)

    def lookup(self, name: str, prefix: str, trail: tuple[str, ...] = ()) -> Any:
        path = _file_of(trail)
        root = self.root if path is None else as_schema(self.files[path])
        local = [root.get("$defs") or {}, root.get("definitions") or {}]
        shared = [self.components]
        # Last, what the shared schemas define for themselves that led here.
        within = [as_schema(as_schema(self.components.get(t)).get(k)) for t in reversed(trail) for k in ("$defs", "definitions")]
        for scope in (shared + local if prefix.startswith("#/components") else local + shared) + within:
            if name in scope:
                return scope[name]
        raise ContractError(f"referenced schema {name!r} not found")

    def checks_of(self, f: Field) -> list[Check]:
        """Checks of a field: nested objects contribute those of their leaves only."""
        if isinstance(f.data_type, T.StructType):
            return [check for child in f.children for check in self.checks_of(child)]
        if isinstance(f.data_type, T.MapType):
            return []
        return checks_for(f.path, f.data_type, f.required, f.constraints)
