"""That work is spread over tasks and done once, whatever the files a table comes in."""

import contextlib
import io

import pytest

from registry import catalog_queries as Q
from tablepact.operators import closure
from tablepact.operators.closure import schema_closure
from tablepact.operators.references import reached_files
from tablepact.sources.specs import Catalog, parse_catalog

TABLES = {
    "part": ["id as p_partkey", "concat('part ', id) as p_name", "'Brand#1' as p_brand", "cast(id % 50 as int) as p_size"],
    "customer": ["id as c_custkey", "concat('C', id) as c_name", "cast(id % 25 as int) as c_nationkey", "'AUTO' as c_mktsegment"],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of one file with one row group each."""
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, columns in TABLES.items():
        spark.range(400).selectExpr(*columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def sizes(df):
    """Rows of each task that has any."""
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_rendered_corpora_are_dealt_over_tasks(spark, folder):
    specs, files = Q.file_corpus(spark, folder)
    for df in (Q.corpus(spark, folder), specs, files):
        found = sizes(df)
        assert len(found) >= 4 and max(found) < 2 * min(found)


def test_schema_files_are_read_once(spark, folder):
    specs, files = Q.file_corpus(spark, folder)
    found = reached_files(parse_catalog(specs), files)
    assert "ArrowEvalPython" not in plan(found)
    paths = {r.path: r["count"] for r in found.groupBy("path").count().collect()}
    boxes, codes = sum(n % 7 > 0 for n in range(400)), sum(n % 11 > 0 for n in range(400))
    # A box is reached by goods whatever else is there; codes by the boxes' tag.
    assert paths == {"schemas/goods.json": 400, "schemas/box.json": boxes, "schemas/codes.yaml": codes}


def test_breaks_read_each_schema_once(spark, folder):
    """What parses schemas is left in no plan but for the references of ports, once; ``holds`` judges parts of files."""
    found = Q.breaks(spark, folder)
    assert plan(found).count("ArrowEvalPython [") == 2
    assert found.count() == sum(
        (n % 5 == 0) + (n % 7 == 0)  # customers
        + (n % 7 == 0) + (n % 11 == 0 and n % 7 > 0) + (n % 11 == 0) + (n % 13 == 0 and n % 11 > 0) + (n % 7 == 0 and n % 11 > 0) + (n % 5 == 0)
        for n in range(400)
    )


def test_closure_reads_schemas_once_and_gives_each_once(spark, folder):
    def ref(name):
        return f'{{"$ref":"#/components/schemas/{name}"}}'

    def obj(*names):
        return '{"properties":{' + ",".join(f'"{n}":{ref(n)}' for n in names) + "}}"

    chain = [("g", f"c{n}", obj(f"c{n + 1}")) for n in range(12)] + [("g", "c12", obj("c3"))]
    components = spark.createDataFrame([*chain, *chain[:3], ("g", "side", obj("c5", "c11"))], "product string, name string, schema string")
    ports = [("g", "one", ref("c0")), ("g", "one", ref("c0")), ("g", "two", obj("c10", "side", "gone")), (None, "odd", ref("c0"))]
    ports = spark.createDataFrame(ports, "product string, name string, schema string")
    found = schema_closure(Catalog(None, None, None, ports, None, components))
    assert "ArrowEvalPython" not in plan(found)
    circle = {f"c{n}" for n in range(3, 13)}
    expected = {("one", c) for c in circle | {"c0", "c1", "c2"}} | {("two", c) for c in circle | {"side", "gone"}}
    rows = [(r.port, r.component) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_doubling_leaves_out_steps_that_no_walk_takes(spark, monkeypatch):
    taken = []
    doubled = closure._doubled
    monkeypatch.setattr(closure, "_doubled", lambda roots, steps, folder: taken.append(steps.count()) or doubled(roots, steps, folder))
    halves = spark.range(1, 1024).selectExpr("'g' as product", "cast(id as string) as component", "cast(id div 2 as string) as next")
    roots = spark.range(1, 1024).selectExpr("'g' as product", "cast(id as string) as root")
    found = closure.reachable(roots, halves)
    assert found.count() == sum(n.bit_length() + 1 for n in range(1, 1024))
    assert taken == [1023 // 16]


def test_part_graph_is_dealt_over_tasks(spark, folder):
    graph = Q.part_graph(spark, folder)
    for df in (graph.ports, graph.components):
        found = sizes(df)
        assert len(found) >= 4 and max(found) < 2 * min(found)
