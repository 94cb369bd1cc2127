"""References through shared schemas and schema files, as far as ports reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablepact.operators import catalog as C
from tablepact.operators import closure
from tablepact.operators.closure import reachable
from tablepact.operators.references import broken_references, edges_of, reached_files, schema_edges, schema_uses
from tablepact.plans.contract import Contract
from tablepact.sources.specs import field_catalog, parse_catalog

FILES = "product string, path string, schema string"


def ref(target):
    return {"$ref": target}


def obj(**properties):
    return {"type": "object", "properties": properties}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(spark, **specs):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in specs.items()], "product string, spec string")


def spec(ports, **schemas):
    return {"connections": {}, "ports": {n: {"connections": [], "schema": s} for n, s in ports.items()}, "components": {"schemas": schemas}}


DEEP = spec(
    {"p": obj(a=ref("#/components/schemas/One")), "q": ref("#/components/schemas/One"), "clean": obj(b=ref("#/components/schemas/Two"))},
    One=obj(x=ref("#/components/schemas/Two"), y=ref("#/components/schemas/Deep")),
    Two=obj(z=ref("#/$defs/Own"), **{"s": {"type": "string"}}) | {"definitions": {"Own": {"type": "integer"}}},
    Deep=obj(f=ref("./gone.yaml"), n=ref("#/$defs/Nope"), t=ref("#/$defs/Two"), c=ref("#/components/schemas/Missing")),
    Unused=obj(f=ref("never.json"), n=ref("#/$defs/Never"), c=ref("#/components/schemas/Nobody")),
)


def test_breaks_two_schemas_deep_are_rows_of_each_port(spark):
    catalog = parse_catalog(corpus(spark, deep=DEEP))
    expected = [("deep", p, t, f"{kind} not found") for p in "pq" for t, kind in (("Missing", "schema"), ("Nope", "definition"))]
    assert rows(broken_references(catalog)) == sorted(expected, key=repr)
    none = spark.createDataFrame([], "product string, path string")
    assert rows(broken_references(catalog, none)) == sorted([*expected, *(("deep", p, "gone.yaml", "file not found") for p in "pq")], key=repr)
    held = spark.createDataFrame([("deep", "./gone.yaml", "type: string"), ("other", "x", "")], FILES)
    assert rows(broken_references(catalog, held)) == sorted(expected, key=repr)


def test_a_port_may_define_what_a_shared_schema_names(spark):
    one = {**DEEP, "ports": {"p": {"schema": obj(a=ref("#/components/schemas/Deep")) | {"$defs": {"Nope": {"type": "string"}}}}}}
    assert rows(broken_references(parse_catalog(corpus(spark, deep=one)))) == [("deep", "p", "Missing", "schema not found")]


FILE_SPEC = spec({"p": ref("a/main.yaml"), "q": obj(x=ref("a/parts.json#/$defs/Item")), "r": ref("a/loop.json")}, Shared={"type": "string", "maxLength": 4})
FILE_ROWS = [
    ("f", "./a/main.yaml", "type: object\nrequired: [k]\nproperties:\n  k: {type: integer}\n  item: {$ref: 'parts.json#/$defs/Item'}\n  far: {$ref: '../b/far.json'}\n"),
    ("f", "a/parts.json", json.dumps({"$defs": {"Item": obj(n={"type": "number"}, s=ref("#/components/schemas/Shared"), own=ref("#/$defs/Text")), "Text": {"type": "string"}}})),
    ("f", "b/far.json", json.dumps(obj(back=ref("../a/parts.json#/$defs/Text")))),
    ("f", "a/loop.json", json.dumps(obj(again=ref("loop2.json")))),
    ("f", "a/loop2.json", json.dumps(obj(again=ref("./loop.json")))),
    ("f", "unused.json", json.dumps(ref("nowhere.json"))),
    ("g", "a/main.yaml", "- no schema"),
]


def test_fields_of_schemas_in_files(spark):
    specs = corpus(spark, f=FILE_SPEC, g=spec({"p": ref("a/main.yaml")}), h=spec({"p": ref("a/main.yaml"), "plain": obj(a={"type": "string"})}))
    files = spark.createDataFrame(FILE_ROWS, FILES)
    reached = reached_files(parse_catalog(specs), files)
    assert {(r["product"], r.path) for r in reached.collect()} == {(p, path.removeprefix("./")) for p, path, _ in FILE_ROWS} - {("f", "unused.json")}
    found = field_catalog(specs, files=reached).collect()
    assert {(r.port, r.path): (r.type, r.required, r.constraints) for r in found if r["product"] == "f" and not r.error} == {
        ("p", "k"): ("bigint", True, ""), ("p", "item.n"): ("double", False, ""), ("p", "item.s"): ("string", False, "maxLength: 4"),
        ("p", "item.own"): ("string", False, ""), ("p", "far.back"): ("string", False, ""),
        ("q", "x.n"): ("double", False, ""), ("q", "x.s"): ("string", False, "maxLength: 4"), ("q", "x.own"): ("string", False, ""),
    }
    errors = {(r["product"], r.port): r.error for r in found if r.error}
    assert errors.pop(("f", "r")).startswith("schema reference cycle: ")
    assert errors == {("g", "p"): "file 'a/main.yaml' holds no schema", ("h", "p"): "file 'a/main.yaml' not found"}
    assert {(r["product"], r.port) for r in field_catalog(specs).where("error is not null").collect()} == {("f", p) for p in "pqr"} | {("g", "p"), ("h", "p")}


def test_breaks_in_files(spark):
    lost = [("f", "a/main.yaml", "properties: {x: {$ref: 'parts.json#/$defs/No'}, y: {$ref: '#/$defs/Nil'}, z: {$ref: '#/components/schemas/Shared'}}"), *FILE_ROWS[1:4:2]]
    catalog = parse_catalog(corpus(spark, f=FILE_SPEC))
    assert rows(broken_references(catalog, spark.createDataFrame(lost, FILES))) == [
        ("f", "p", "Nil", "definition not found"), ("f", "p", "a/parts.json#/$defs/No", "definition not found"), ("f", "r", "a/loop2.json", "file not found"),
    ]
    assert broken_references(catalog, spark.createDataFrame(FILE_ROWS, FILES)).count() == 0


def test_paths_are_relative_to_the_file_that_names_them():
    text = json.dumps([ref("x.json#/a/b"), ref("../y.yaml"), ref("./x.json"), ref("#/components/schemas/C")])
    assert set(edges_of(text, "dir/in.json")) == {("component", "C"), ("file", "dir/x.json"), ("file", "y.yaml"), ("inside", "dir/x.json#/a/b")}
    assert edges_of(None, "") == edges_of("{", "") == []


def test_definitions_of_ports_and_shared_schemas_conflict(spark):
    a, b = {"type": "string"}, {"type": "integer"}
    old = {"p": obj() | {"definitions": {"Mark": b}}}
    specs = corpus(
        spark, old=spec(old, Mark=a), same=spec(old, Mark=b), inner=spec({}, Mark=a, Box=obj() | {"$defs": {"Mark": b}}),
        locals=spec({}, Box=obj() | {"$defs": {"L": a}}, Bag=obj() | {"definitions": {"L": b}}), port=spec({"L": obj(x=a)}, Box=obj() | {"$defs": {"L": a}}),
    )
    assert rows(C.duplicate_names(parse_catalog(specs))) == [("inner", "Mark", 2, 2), ("old", "Mark", 2, 2), ("port", "L", 2, 2)]


def test_own_definitions_of_shared_schemas_compile():
    schemas = {"Tag": obj(m=ref("#/$defs/Mark")) | {"$defs": {"Mark": {"type": "integer"}}}}
    leaves = Contract.from_schema(obj(t=ref("#/components/schemas/Tag")), "p", schemas).leaves()
    assert [(f.dotted, f.data_type.simpleString()) for f in leaves] == [("t.m", "bigint")]
    with_own = obj(t=ref("#/components/schemas/Tag")) | {"$defs": {"Mark": {"type": "string"}}}
    assert Contract.from_schema(with_own, "p", schemas).leaves()[0].data_type.simpleString() == "string"


def edges(spark, pairs):
    return spark.createDataFrame([("g", str(a), str(b)) for a, b in pairs], "product string, component string, next string")


def reach(pairs, root):
    seen, todo = {root}, [root]
    while todo:
        at = todo.pop()
        for a, b in pairs:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return {(str(root), str(b)) for b in seen}


@pytest.mark.parametrize("steps", [1, 3, 32])
def test_reaching_by_steps_then_by_doubling(spark, monkeypatch, steps):
    monkeypatch.setattr(closure, "FRONTIER", steps)
    dice = random.Random(steps)
    pairs = sorted({(dice.randrange(15), dice.randrange(15)) for _ in range(20)} | {(20 + i, 21 + i) for i in range(9)})
    roots = spark.createDataFrame([("g", str(r)) for r in (0, 3, 7, 20, 99)], "product string, root string")
    found = {(r.root, r.component) for r in reachable(roots, edges(spark, pairs)).collect()}
    assert found == set().union(*(reach(pairs, r) for r in (0, 3, 7, 20, 99)))


def test_schemas_no_port_names_cost_no_rows(spark, monkeypatch):
    """Rounds store what roots reach, not the paths of the whole graph; a hub is one row per root."""
    counts = []
    written = closure._written
    monkeypatch.setattr(closure, "_written", lambda df, path: counts.append(written(df, path)) or counts[-1])
    chain = spark.range(3000).selectExpr("'g' as product", "concat('c', id) as component", "concat('c', id + 1) as next")
    hub = spark.range(500).selectExpr("'g' as product", "concat('r', id) as component", "'hub' as next")
    leaves = spark.range(3).selectExpr("'g' as product", "'hub' as component", "concat('leaf', id) as next")
    roots = spark.range(500).selectExpr("'g' as product", "concat('r', id) as root")
    found = reachable(roots, chain.unionAll(hub).unionAll(leaves))
    assert found.count() == 500 * 5
    assert [n for _, n in counts] == [3503, 500, 1500, 0]


def test_uses_of_nothing(spark):
    catalog = parse_catalog(corpus(spark, e=spec({})))
    assert schema_uses(schema_edges(catalog)).count() == 0
    assert broken_references(catalog, spark.createDataFrame([], FILES)).count() == 0
    assert reached_files(catalog, spark.createDataFrame(FILE_ROWS, FILES).where(F.lit(False))).count() == 0
