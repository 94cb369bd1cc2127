"""Compiling contracts: types, order, references, checks."""

import pytest
from pyspark.sql import types as T

from tablepact import Contract, ContractError, contracts_of


def compiled(properties, required=(), **more):
    return Contract.from_schema({"type": "object", "required": list(required), "properties": properties, **more}, "t")


def rules(contract):
    return [(c.rule, c.column) for c in contract.checks]


@pytest.mark.parametrize(
    "declared, expected",
    [
        ({"type": "string"}, T.StringType()),
        ({"type": "integer"}, T.LongType()),
        ({"type": "number"}, T.DoubleType()),
        ({"type": "boolean"}, T.BooleanType()),
        ({"type": "null"}, T.StringType()),
        ({}, T.StringType()),
        (True, T.StringType()),
        ({"type": ["integer", "null"]}, T.StringType()),
        ({"type": "string", "format": "date"}, T.DateType()),
        ({"type": "string", "format": "date-time"}, T.TimestampType()),
        ({"type": "integer", "format": "date"}, T.DateType()),
        ({"type": "string", "format": "uuid"}, T.StringType()),
        ({"type": "string", "format": "uri"}, T.StringType()),
        ({"type": "array", "items": {"type": "integer"}}, T.ArrayType(T.LongType())),
        ({"type": "array"}, T.ArrayType(T.StringType())),
        ({"type": "array", "items": [{"type": "integer"}]}, T.ArrayType(T.StringType())),
        ({"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, T.ArrayType(T.ArrayType(T.DoubleType()))),
        ({"type": "object", "additionalProperties": True}, T.MapType(T.StringType(), T.StringType())),
        ({"properties": {"a": {"type": "integer"}}}, T.StructType([T.StructField("a", T.LongType())])),
    ],
)
def test_type_mapping(declared, expected):
    assert compiled({"x": declared}).schema["x"].dataType == expected


def test_order_is_source_order_and_nullability_comes_from_required():
    c = compiled({"z": {"type": "string"}, "a": {"type": "integer"}, "m": {}}, required=["a"])
    assert c.column_names == ["z", "a", "m"]
    assert [f.nullable for f in c.schema] == [True, False, True]


def test_descriptions_become_comments():
    c = compiled({"a": {"description": "first"}, "b": {}})
    assert c.schema["a"].metadata == {"comment": "first"} and c.schema["b"].metadata == {}


@pytest.mark.parametrize("prefix", ["#/$defs/", "#/definitions/", "#/components/schemas/"])
def test_references_in_every_spelling(prefix):
    address = {"type": "object", "properties": {"city": {"type": "string"}}}
    schema = {"type": "object", "properties": {"home": {"$ref": prefix + "Address", "type": "integer"}}}
    for place in ({"$defs": {"Address": address}}, {"definitions": {"Address": address}}):
        assert Contract.from_schema({**schema, **place}).schema["home"].dataType.names == ["city"]
    assert Contract.from_schema(schema, components={"Address": address}).schema["home"].dataType.names == ["city"]


def test_root_reference_and_arrays_of_references():
    node = {"type": "object", "properties": {"n": {"type": "integer"}}}
    user = {"type": "object", "properties": {"nodes": {"type": "array", "items": {"$ref": "#/components/schemas/Node"}}}}
    c = Contract.from_schema({"$ref": "#/components/schemas/User"}, "u", {"User": user, "Node": node})
    assert c.schema["nodes"].dataType == T.ArrayType(T.StructType([T.StructField("n", T.LongType())]))


def test_two_inline_objects_of_one_name_do_not_collide():
    def side(kind, **rule):
        return {"type": "object", "properties": {"address": {"type": "object", "properties": {"v": {"type": kind, **rule}}}}}

    c = compiled({"left": side("integer", minimum=1), "right": side("string", minLength=2)})
    assert c.schema["left"].dataType["address"].dataType["v"].dataType == T.LongType()
    assert rules(c) == [("is_not_less_than", "left.address.v"), ("min_length", "right.address.v")]


@pytest.mark.parametrize(
    "components, cycle",
    [
        ({"Node": {"type": "object", "properties": {"parent": {"$ref": "#/components/schemas/Node"}}}}, "Node -> Node"),
        (
            {
                "Node": {"type": "object", "properties": {"boss": {"$ref": "#/components/schemas/Company"}}},
                "Company": {
                    "type": "object",
                    "properties": {"staff": {"type": "array", "items": {"$ref": "#/components/schemas/Node"}}},
                },
            },
            "Node -> Company -> Node",
        ),
    ],
)
def test_cycles_are_named(components, cycle):
    with pytest.raises(ContractError, match=cycle):
        Contract.from_schema({"$ref": "#/components/schemas/Node"}, "nodes", components)


def test_same_schema_twice_is_no_cycle():
    c = compiled({"a": {"$ref": "#/$defs/S"}, "b": {"$ref": "#/$defs/S"}}, **{"$defs": {"S": {"type": "integer"}}})
    assert [f.dataType for f in c.schema] == [T.LongType(), T.LongType()]


def test_reference_to_a_primitive_keeps_its_checks():
    c = compiled({"mark": {"$ref": "#/$defs/Mark"}}, ["mark"], **{"$defs": {"Mark": {"type": "string", "minLength": 2}}})
    assert rules(c) == [("is_not_null", "mark"), ("min_length", "mark")]


@pytest.mark.parametrize("keyword", ["allOf", "anyOf", "oneOf"])
def test_composition_is_refused(keyword):
    with pytest.raises(ContractError, match=keyword):
        Contract.from_schema({keyword: [{"type": "object"}]})
    with pytest.raises(ContractError, match=keyword):
        compiled({"x": {"type": "object", keyword: [{}]}})
    assert compiled({"x": {"type": "string", keyword: [{"format": "email"}]}}).schema["x"].dataType == T.StringType()


@pytest.mark.parametrize("ref", ["other.yaml", "http://example.com/s.json", "#/paths/x", "#/$defs/Gone"])
def test_unresolvable_references(ref):
    with pytest.raises(ContractError):
        compiled({"x": {"$ref": ref}})


def test_check_order_of_one_field():
    everything = {
        "type": "string",
        "maxLength": 9,
        "pattern": "x",
        "minLength": 1,
        "const": "a",
        "enum": ["a"],
        "format": "email",
    }
    assert [r for r, _ in rules(compiled({"s": everything}, ["s"]))] == [
        "is_not_null",
        "is_email",
        "is_in_list",
        "is_equal_to",
        "min_length",
        "max_length",
        "regex_match",
    ]
    numeric = {"type": "number", "multipleOf": 2, "exclusiveMaximum": 9, "exclusiveMinimum": 1, "minimum": 0, "maximum": 8}
    assert [r for r, _ in rules(compiled({"n": numeric}))] == [
        "is_in_range",
        "exclusive_minimum",
        "exclusive_maximum",
        "multiple_of",
    ]


def test_required_object_has_no_check_of_its_own():
    inner = {"type": "object", "required": ["street"], "properties": {"street": {}, "country": {"pattern": "^[A-Z]{2}$"}}}
    assert rules(compiled({"address": inner}, ["address"])) == [
        ("is_not_null", "address.street"),
        ("regex_match", "address.country"),
    ]
    assert rules(compiled({"open": {"type": "object"}}, ["open"])) == []


def test_array_elements_are_not_checked():
    lines = {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["n"], "properties": {"n": {"minimum": 1}}}}
    assert rules(compiled({"lines": lines})) == [("min_items", "lines")]


def test_formats_without_check():
    assert rules(compiled({"a": {"format": "idn-email"}, "b": {"format": "uri"}})) == []


def test_literals_keep_their_type_and_foreign_members_are_dropped():
    c = compiled(
        {
            "n": {"type": "integer", "enum": [1, 2.0, 2.5, "3", True, None]},
            "s": {"type": "string", "enum": ["1", "true", 1, True, None]},
            "b": {"type": "boolean", "enum": [True, 1, "true"]},
            "d": {"type": "number", "const": 7},
            "day": {"format": "date", "enum": ["2024-01-01", "soon"]},
            "none": {"type": "string", "const": None},
        }
    )
    assert [check.args[0] for check in c.checks if check.args] == [(1, 2), ("1", "true"), (True,), (7.0,), ("2024-01-01", "soon")]
    assert all(type(v) is int for v in c.checks[0].args[0])


@pytest.mark.parametrize(
    "rule",
    [
        {"type": "integer", "multipleOf": 0},
        {"type": "integer", "multipleOf": -1},
        {"type": "integer", "minimum": "5"},
        {"type": "string", "minLength": 1.5},
        {"type": "string", "minItems": 1},
        {"type": "boolean", "minimum": 0},
        {"type": "string", "format": "date", "maximum": 3},
        {"type": "string", "enum": "ab"},
        {"type": "string", "pattern": 5},
        {"type": "string", "format": ["date"]},
        {"properties": ["a"]},
        {"type": "object", "required": 1, "properties": {"a": {}}},
    ],
)
def test_rules_that_make_no_sense_are_refused(rule):
    with pytest.raises(ContractError):
        compiled({"x": rule})


def test_messages():
    c = compiled(
        {
            "age": {"type": "integer", "minimum": 18.0, "maximum": 65.5},
            "rate": {"type": "number", "exclusiveMinimum": 0, "multipleOf": 0.5},
            "ok": {"type": "boolean", "const": True},
            "ip": {"format": "ipv4"},
        },
        required=["age"],
    )
    assert [check.message for check in c.checks] == [
        "age must not be null",
        "age must be between 18 and 65.5",
        "rate must be greater than 0",
        "rate must be a multiple of 0.5",
        "ok must equal true",
        "ip must be a valid IPv4 address",
    ]


def test_root_must_be_an_object():
    with pytest.raises(ContractError, match="array"):
        Contract.from_schema({"type": "array"}, "x")


def test_contracts_of_a_spec():
    spec = {
        "ports": {
            "users": {"schema": {"$ref": "#/components/schemas/User"}},
            "bare": {"connections": []},
        },
        "components": {"schemas": {"User": {"type": "object", "properties": {"id": {"type": "integer"}}}}},
    }
    found = contracts_of(spec)
    assert found["users"].column_names == ["id"] and found["bare"] is None


FILES = {
    "schemas/user.yaml": {
        "type": "object",
        "required": ["id"],
        "properties": {"id": {"type": "integer"}, "home": {"$ref": "common/address.json"}, "tag": {"$ref": "#/$defs/Tag"}},
        "$defs": {"Tag": {"type": "string", "maxLength": 3}},
    },
    "schemas/common/address.json": {"definitions": {"City": {"type": "string"}}, "type": "object", "properties": {"city": {"$ref": "#/definitions/City"}}},
    "loop.json": {"type": "object", "properties": {"again": {"$ref": "loop.json"}}},
}


def test_schemas_in_other_files():
    contract = Contract.from_schema({"$ref": "schemas/user.yaml"}, files=FILES)
    assert contract.schema.simpleString() == "struct<id:bigint,home:struct<city:string>,tag:string>"
    assert {c.rule for c in contract.checks} == {"is_not_null", "max_length"}
    part = Contract.from_schema({"properties": {"c": {"$ref": "./schemas/common/address.json#/definitions/City"}}}, files=FILES)
    assert part.schema.simpleString() == "struct<c:string>"


@pytest.mark.parametrize(
    ("schema", "message"),
    [
        ({"$ref": "schemas/none.yaml"}, "file 'schemas/none.yaml' not found"),
        ({"$ref": "loop.json"}, "cycle"),
        ({"properties": {"c": {"$ref": "schemas/user.yaml#/$defs/None"}}}, "is not in file"),
    ],
)
def test_files_that_are_not_there(schema, message):
    with pytest.raises(ContractError, match=message):
        Contract.from_schema(schema, files=FILES)


def test_schemas_that_no_plan_could_hold_are_refused():
    levels = {f"L{n}": {"type": "object", "properties": {k: {"$ref": f"#/$defs/L{n + 1}"} for k in "ab"}} for n in range(30)}
    with pytest.raises(ContractError, match="more than 5000 fields"):
        Contract.from_schema({"$defs": {**levels, "L30": {"type": "string"}}, "properties": {"x": {"$ref": "#/$defs/L0"}}})
