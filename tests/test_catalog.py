"""Catalog tables from spec documents, and the questions about them."""

import dataclasses
import json
import random
import re
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tablepact import contracts_of, load_specs, read_spec
from tablepact.errors import ContractError
from tablepact.operators import catalog as C
from tablepact.operators.closure import component_edges, reachable, schema_closure
from tablepact.operators.joins import lookup
from tablepact.sources.specs import Catalog, constraint_text, field_catalog, field_rows, parse_catalog, yaml_as_json

SHOP = """
info: {title: Shop analytics, version: "2.0.0", description: Numbers of the shop}
tags:
  - {name: orders, description: Order data}
  - {name: real-time}
connections:
  warehouse:
    type: postgresql
    host: warehouse.example.com:5432
    description: Main analytics data warehouse of the shop
    variables: {database: analytics, schema: public, pool: {size: 3}, since: 2024-01-01, switch: off}
  archive:
    type: postgresql
    host: warehouse.example.com:5432
  stream:
    type: kafka
    host: kafka.example.com:9092
    description: Events
  spare: {type: s3, host: spare, description: ""}
ports:
  daily_orders:
    description: Daily aggregated order metrics of every shop there is
    connections:
      - {connection: "#/connections/warehouse", location: daily}
      - {connection: "#/connections/lost", location: nowhere}
      - {connection: "#/connections/archive", location: old}
    schema:
      type: object
      required: [date, total]
      properties:
        date: {type: string, format: date, description: Day}
        total: {type: integer, minimum: 0, maximum: 1.5}
        region: {type: string, enum: [north, 1, true, null], const: north, pattern: "^n"}
        buyer: {$ref: "#/components/schemas/Buyer"}
  order_events:
    connections:
      - {connection: "#/connections/stream", location: order-events}
    schema: {$ref: "#/components/schemas/Event"}
  plain: {description: nothing here, connections: []}
components:
  schemas:
    Buyer: {type: object, properties: {name: {type: string, minLength: 1}, home: {$ref: "#/components/schemas/Gone"}}}
    Event: {type: object, properties: {lines: {type: array, maxItems: 2, items: {type: object, properties: {n: {type: integer}}}}}}
"""
MINIMAL = {"info": {"title": "Tiny", "version": "1"}, "connections": {}, "ports": {}}


@pytest.fixture(scope="module")
def specs(spark):
    rows = [(1, SHOP), (2, json.dumps(MINIMAL)), (3, "{ not a spec"), (4, "- just\n- a list"), (5, '{"ports": {"p": "x", "q": {"schema": {"properties": 1}}}}')]
    return spark.createDataFrame(rows, "product int, spec string")


@pytest.fixture(scope="module")
def shop(specs, spark, tmp_path_factory):
    """The corpus parsed once, stored and read back."""
    folder = str(tmp_path_factory.mktemp("catalog"))
    parse_catalog(specs, fmt="yaml").write(folder)
    return Catalog.read(spark, folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_products_and_tags(shop):
    assert rows(shop.products)[:2] == [(1, "Shop analytics", "2.0.0", "Numbers of the shop", True), (2, "Tiny", "1", None, True)]
    assert [r.readable for r in shop.products.where("product in (3, 4)").collect()] == [False, False]
    assert rows(shop.tags) == [(1, 0, "orders", "Order data"), (1, 1, "real-time", None)]


def test_variables_are_text(shop):
    found = {r.variable: r.value for r in C.connection_variables(shop).collect()}
    assert found.pop("pool").replace(" ", "") == '{"size":3}'
    assert found == {"database": "analytics", "schema": "public", "since": "2024-01-01", "switch": "off"}


def test_json_and_yaml_give_the_same_catalog(spark):
    import yaml

    doc = yaml.load(SHOP, Loader=yaml.BaseLoader)
    doc["connections"]["warehouse"]["variables"].pop("pool")
    texts = {"json": json.dumps(doc), "yaml": yaml.safe_dump(doc, sort_keys=False)}
    parsed = {
        fmt: parse_catalog(spark.createDataFrame([(1, text)], "product int, spec string"), fmt=fmt)
        for fmt, text in texts.items()
    }
    for table in ("products", "tags", "connections", "port_connections"):
        assert rows(getattr(parsed["json"], table)) == rows(getattr(parsed["yaml"], table))
    assert rows(parsed["json"].ports.select("product", "name")) == rows(parsed["yaml"].ports.select("product", "name"))


def test_specs_from_a_folder(spark, tmp_path):
    for name, text in (
        ("shop/a-config.yaml", "debug: true"),
        ("shop/product.yaml", SHOP),
        ("shop/product.json", json.dumps(MINIMAL)),
        ("tiny + one/product.json", json.dumps(MINIMAL)),
        ("none/readme.txt", "no spec"),
    ):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    catalog = parse_catalog(load_specs(spark, str(tmp_path), "product"), fmt="yaml")
    assert rows(catalog.products.select("product", "title")) == [("shop", "Shop analytics"), ("tiny + one", "Tiny")]
    assert catalog.ports.count() == 3


def test_unknown_spec_format(specs):
    with pytest.raises(ContractError, match="toml"):
        parse_catalog(specs, fmt="toml")


def test_port_listing(shop):
    assert [tuple(r) for r in C.port_listing(shop).collect()] == [
        (1, "daily_orders", "Daily aggregated order metrics of eve...", "archive:daily, unknown:nowhere, archive:old"),
        (1, "order_events", "-", "stream:order-events"),
        (1, "plain", "nothing here", "-"),
    ]


def test_a_port_of_very_many_locations_is_one_row(spark, shop):
    uses = spark.range(5000).selectExpr(
        "1 as product", "'plain' as port", "cast(id as int) as pos", "'stream' as connection", "concat('l', id) as location"
    )
    listing = C.port_listing(dataclasses.replace(shop, port_connections=uses)).where("name = 'plain'").collect()
    assert [r.connections for r in listing] == [", ".join(f"stream:l{i}" for i in range(5000))]
    assert C.port_locations(dataclasses.replace(shop, port_connections=uses)).count() == 5000


def test_connection_usage(shop):
    assert {r.name: (r.description, r.ports, r.used_by) for r in C.connection_usage(shop).collect()} == {
        "warehouse": ("Main analytics data warehou...", 1, "1 port"),
        "archive": ("-", 1, "1 port"),
        "stream": ("Events", 1, "1 port"),
        "spare": ("-", 0, "-"),
    }


def test_connection_details(shop):
    variables, ports = C.describe_connection(shop, 1, "warehouse")
    assert [r.variable for r in variables.collect()] == ["database", "pool", "schema", "since", "switch"]
    assert [(r.port, r.location) for r in ports.orderBy("location").collect()] == [
        ("daily_orders", "daily"),
        ("daily_orders", "old"),
    ]
    variables, ports = C.describe_connection(shop, 1, "spare")
    assert variables.count() == 0 and ports.count() == 0


def test_removable_and_blocked(shop):
    assert [r.connection for r in C.removable_connections(shop).collect()] == ["spare"]
    assert sorted(r.connection for r in C.blocked_connections(shop).collect()) == ["archive", "stream", "warehouse"]
    assert rows(C.endpoint_users(shop).select("type", "port")) == [("kafka", "order_events"), ("postgresql", "daily_orders")]


def test_dangling_references(shop):
    direct = [(1, "daily_orders", "lost", "connection not found")]
    assert rows(C.dangling_references(shop)) == direct
    assert rows(C.dangling_references(shop, schema_closure(shop))) == [
        (1, "daily_orders", "Gone", "schema not found"),
        *direct,
    ]


def test_duplicate_names(spark):
    def named(**schemas):
        return {"ports": schemas.pop("ports", {}), "components": {"schemas": schemas}}

    a, b = {"type": "string", "minLength": 1}, {"type": "integer"}
    respelled = {"minLength": 1, "type": "string"}
    specs = {
        "same": named(A=a, ports={"p": {"schema": {"type": "object", "$defs": {"A": respelled}}}}),
        "local": named(A=a, ports={"p": {"schema": {"type": "object", "$defs": {"A": b}}}}),
        "port": named(A=a, ports={"A": {"schema": b}}),
        "ref": named(A=a, ports={"A": {"schema": {"$ref": "#/components/schemas/A"}}}),
        "locals": named(
            ports={n: {"schema": {"type": "object", "$defs": {"L": s}}} for n, s in (("p", a), ("q", b))}
        ),
    }
    catalog = parse_catalog(spark.createDataFrame([(k, json.dumps(v)) for k, v in specs.items()], "product string, spec string"))
    assert rows(C.duplicate_names(catalog)) == [("local", "A", 2, 2), ("port", "A", 2, 2)]


def test_field_catalog(specs):
    found = {(r.port, r.path): (r.type, r.required, r.constraints) for r in field_catalog(specs, fmt="yaml").collect() if not r.error}
    assert found == {("order_events", "lines"): ("array<struct<n:bigint>>", False, "maxItems: 2"), ("order_events", "lines[].n"): ("bigint", False, "")}
    errors = {(r.product, r.port): r.error for r in field_catalog(specs, fmt="yaml").where("error is not null").collect()}
    assert errors == {
        ("1", "daily_orders"): "referenced schema 'Gone' not found",
        ("3", None): "the spec is not readable",
        ("4", None): "the spec is not readable",
        ("5", "p"): "'str' object has no attribute 'get'",
        ("5", "q"): "q is malformed: 'int' object has no attribute 'items'",
    }


def test_contracts_straight_from_a_document():
    contracts = contracts_of(read_spec(SHOP.replace("Gone", "Event")))
    assert contracts["plain"] is None and contracts["order_events"].column_names == ["lines"]
    assert [c.rule for c in contracts["daily_orders"].checks if c.column == "region"] == [
        "is_in_list",
        "is_equal_to",
        "regex_match",
    ]
    assert read_spec("{a: b}") == {"a": "b"}
    with pytest.raises(ContractError, match="not readable"):
        read_spec("a: [")


@pytest.mark.parametrize("function", [yaml_as_json, field_rows])
def test_executors_need_no_copy_of_the_package(function, tmp_path):
    (tmp_path / "function").write_bytes(cloudpickle.dumps(function))
    script = f"""
import pickle, pandas as pd
with open("function", "rb") as f:
    function = pickle.load(f)
specs = pd.DataFrame({{"product": ["1"], "text": ['{{"ports": {{"p": {{"schema": {{"properties": {{"a": {{}}}}}}}}}}}}']}})
out = function(specs["text"]) if function.__name__ == "yaml_as_json" else next(function(iter([specs])))
assert len(out) == 1, out
"""
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, timeout=60)


def test_constraint_text():
    rules = {"enum": ["a", 1, True, None], "const": 2.0, "pattern": "^a", "format": "date", "minimum": 1.5, "maxItems": 3}
    assert constraint_text(rules) == "enum: `a`, `1`, `true`, `null`, const: `2`, pattern: `^a`, format: date, minimum: 1.5, maxItems: 3"


def graph_catalog(spark, edges, roots):
    targets = {}
    for a, b in edges:
        targets.setdefault(a, []).append(b)
        targets.setdefault(b, [])
    components = [
        ("g", a, json.dumps({"properties": {f"x{n}": {"$ref": f"#/components/schemas/{b}"} for n, b in enumerate(bs)}}))
        for a, bs in targets.items()
    ]
    ports = [("g", f"port{n}", "", json.dumps({"$ref": f"#/components/schemas/{r}"})) for n, r in enumerate(roots)]
    return Catalog(
        None,
        None,
        None,
        spark.createDataFrame(ports, "product string, name string, description string, schema string"),
        None,
        spark.createDataFrame(components, "product string, name string, schema string"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_against_brute_force(spark, seed):
    dice = random.Random(seed)
    nodes = [f"n{i}" for i in range(12)]
    edges = sorted({(dice.choice(nodes), dice.choice(nodes)) for _ in range(16)})
    known = sorted({n for e in edges for n in e})
    roots = [dice.choice(known) for _ in range(5)]

    def reach(root):
        seen, todo = {root}, [root]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    expected = sorted(("g", f"port{n}", c) for n, root in enumerate(roots) for c in reach(root))
    assert rows(schema_closure(graph_catalog(spark, edges, roots))) == expected


def test_references_are_found_however_slashes_are_written(spark):
    text = r'{"a": {"$ref" : "#/components/schemas/A"}, "b": [{"$ref":"#\/components\/schemas\/B"}]}'
    assert sorted(C.read_references(text)) == [("component", "A"), ("component", "B")]
    assert C.read_references(None) == C.read_references("no json") == C.read_references("[" * 9999) == []


def test_references_of_all_kinds_are_judged(spark, shop):
    ref = lambda target: {"$ref": target}
    schema = {
        "$defs": {"Here": {"type": "string"}},
        "properties": {
            "a": ref("#/$defs/Here"), "b": ref("#/$defs/Gone"), "c": ref("./there.yaml#/x"), "d": ref("lost.json"),
            "e": {"const": ref("#/components/schemas/Nothing"), "enum": [ref("other.json")]},
        },
    }
    ports = spark.createDataFrame([(1, "p", None, json.dumps(schema))], "product int, name string, description string, schema string")
    files = spark.createDataFrame([(1, "there.yaml")], "product int, path string")
    catalog = dataclasses.replace(shop, ports=ports, port_connections=shop.port_connections.where("false"))
    assert rows(C.dangling_references(catalog)) == [(1, "p", "Gone", "definition not found")]
    assert rows(C.dangling_references(catalog, files=files)) == [
        (1, "p", "Gone", "definition not found"), (1, "p", "lost.json", "file not found"),
    ]


def test_closure_of_nothing(spark):
    catalog = graph_catalog(spark, [("a", "b")], ["a"])
    empty = catalog.ports.where("false").selectExpr("product", "name as root")
    assert reachable(empty, component_edges(catalog)).count() == 0


@pytest.fixture
def skewed(spark):
    """Thresholds at which a small table is large, and no broadcast to hide behind."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(column, every=3):
    return F.when(F.col("id") % every == 0, F.lit("hot")).otherwise(F.concat(F.lit(column), (F.col("id") % 500)))


def final_plan(df):
    df._jdf.queryExecution().executedPlan().executeCollect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_hot_key_is_split_even_when_the_other_side_is_aggregated(spark, skewed):
    left = spark.range(60000).select(hot("k").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup(left, right, ["key"])
    assert "SortMergeJoin(skew=true)" in final_plan(joined)
    assert joined.where("n is null").count() == 0 and joined.count() == 60000


def test_questions_about_a_skewed_catalog(spark, skewed):
    digest = F.sha2(F.col("id").cast("string"), 256)
    product = F.lit("p").alias("product")
    catalog = Catalog(
        None,
        None,
        spark.range(3000).select(
            product, F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("c"), "id")).alias("name"),
            F.lit("kafka").alias("type"), hot("host").alias("host"), digest.alias("description"),
            F.create_map(F.lit("a"), F.lit("b")).alias("variables"),
        ),
        spark.range(20000).select(product, F.concat(F.lit("port"), "id").alias("name"), digest.alias("description"), F.lit(None).cast("string").alias("schema")),
        spark.range(60000).select(
            product, F.concat(F.lit("port"), F.col("id") % 20000).alias("port"), F.floor(F.col("id") / 20000).cast("int").alias("pos"),
            hot("c").alias("connection"), digest.alias("location"),
        ),
        None,
    )
    ports = C.connection_ports(catalog)
    assert re.search(r"SortMergeJoin\(skew=true\) \[__spread#\d+L, connection", final_plan(ports))
    usage = {r.name: r.ports for r in C.connection_usage(catalog).collect()}
    assert usage["hot"] == usage["c3"] >= 20000 // 3
    listing = C.port_listing(catalog)
    assert re.search(r"SortMergeJoin\(skew=true\) \[__spread#\d+L, connection", final_plan(listing))
    assert listing.count() == 20000


def test_odd_documents_end_no_corpus(spark):
    """Alias cycles, wrong tags, huge numbers and deep nesting are error rows or unreadable, and the rest stands."""
    deep = "[" * 5000 + "]" * 5000
    huge = {"ports": {"p": {"schema": {"properties": {"n": {"type": "number", "maximum": 10**400}}}}}}
    nested: dict = {"type": "string"}
    for _ in range(400):
        nested = {"type": "object", "properties": {"x": nested}}
    texts = {
        "cycle": "a: &x {b: *x}", "tag": 'a: !!int "x"', "deep": deep, "huge": json.dumps(huge),
        "nested": json.dumps({"ports": {"p": {"schema": nested}}}), "good": json.dumps(MINIMAL),
    }
    specs = spark.createDataFrame(list(texts.items()), "product string, spec string")
    products = {r["product"]: r.readable for r in parse_catalog(specs, fmt="yaml").products.collect()}
    assert products["good"] and not products["cycle"] and not products["tag"]
    found = field_catalog(specs, fmt="yaml").collect()
    assert {r["product"] for r in found if r.error} >= {"cycle", "tag", "huge"}
    assert {r["product"] for r in field_catalog(specs).collect()} >= {"deep"}


def test_empty_const_is_shown():
    assert constraint_text({"const": "", "enum": [], "pattern": ""}) == "const: ``"


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from tablepact.operators import closure

    rounds = []
    stored = closure._stored
    monkeypatch.setattr(closure, "_stored", lambda df, path: rounds.append(path) or stored(df, path))
    edges = spark.range(300).selectExpr("1 as product", "concat('s', id) as component", "concat('s', id + 1) as next")
    roots = spark.createDataFrame([(1, "s0"), (1, "s299")], "product int, root string")
    assert reachable(roots, edges).groupBy("root").count().orderBy("root").collect() == [("s0", 301), ("s299", 2)]
    assert len(rounds) <= 11
