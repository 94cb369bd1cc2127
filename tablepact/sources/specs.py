"""Corpora of data product specs, as catalog tables.

A corpus is a DataFrame with one spec document per row. A spec names a product, its
connections, its ports (published datasets) and shared component schemas.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import islice
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.errors import ContractError
from tablepact.plans.contract import Contract
from tablepact.plans.rules import show
from tablepact.sources.scratch import scratch_path

try:
    import yaml
except ImportError:
    yaml = None

# Executors run two functions of this package; ship its code with them, so that nothing
# has to be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules["tablepact"])

# How YAML 1.2 spells booleans.
BOOLEAN = re.compile("^(true|True|TRUE|false|False|FALSE)$")

CONNECTION_PREFIX = "#/connections/"
COMPONENT_PREFIX = "#/components/schemas/"

SPEC_TYPE = """
    info struct<title: string, version: string, description: string>,
    tags array<struct<name: string, description: string>>,
    connections map<string, struct<
        type: string, host: string, description: string, variables: map<string, string>>>,
    ports map<string, struct<
        description: string,
        connections: array<struct<connection: string, location: string>>,
        schema: string>>,
    components struct<schemas: map<string, string>>
"""


@dataclass(frozen=True)
class Catalog:
    """The tables of a corpus, keyed by product.

    ================ =================================================
    products         product, title, version, description, readable
    tags             product, pos, name, description
    connections      product, name, type, host, description, variables
    ports            product, name, description, schema
    port_connections product, port, pos, connection, location
    components       product, name, schema
    ================ =================================================

    Schemas stay JSON text; ``pos`` is the place in the document's list.
    """

    products: DataFrame
    tags: DataFrame
    connections: DataFrame
    ports: DataFrame
    port_connections: DataFrame
    components: DataFrame

    def write(self, folder: str) -> None:
        """Store the tables as Parquet, so that later questions skip the parsing."""
        for table in fields(self):
            getattr(self, table.name).write.mode("overwrite").parquet(f"{folder}/{table.name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Catalog:
        return cls(*[spark.read.parquet(f"{folder}/{table.name}") for table in fields(cls)])


# Extensions of spec files; where a product has several, the earlier one counts.
SPEC_FILES = ("yaml", "yml", "json")


def load_specs(spark: SparkSession, location: str, stem: str = "spec") -> DataFrame:
    """The corpus kept under a folder: product, spec, one row per folder in it that holds a spec.

    A product is named after its folder, and its spec is the file named ``stem``; other files of
    the folder are not read. YAML goes before JSON.
    """
    files = f"{location.rstrip('/')}/*/{stem}.{{{','.join(SPEC_FILES)}}}"
    path = F.col("_metadata.file_path")
    extension = F.element_at(F.split(path, "[.]"), -1)
    rank = F.array_position(F.lit(list(SPEC_FILES)), extension)
    texts = spark.read.text(files, wholetext=True).select(
        F.url_decode(F.replace(F.element_at(F.split(path, "/"), -2), F.lit("+"), F.lit("%2B"))).alias("product"),
        F.struct(rank.alias("rank"), path.alias("path")).alias("order"),
        F.col("value").alias("spec"),
    )
    return texts.groupBy("product").agg(F.min_by("spec", "order").alias("spec"))


def parse_catalog(specs: DataFrame, product: str = "product", spec: str = "spec", fmt: str = "json") -> Catalog:
    """Turn a corpus into catalog tables.

    ``fmt`` is ``json`` or ``yaml``. JSON is parsed by Spark; YAML is first rewritten as JSON
    on the executors; JSON texts among it are as good. Every document is read and parsed once, into a table in
    shared storage; the catalog's tables read the columns of it that they need.
    """
    texts = specs.select(F.col(product).alias("product"), _as_json(F.col(spec), fmt).alias("text"))
    docs = texts.select("product", F.from_json("text", SPEC_TYPE).alias("doc"), _head(F.col("text")).alias("head"))
    path = scratch_path(specs.sparkSession, "specs")
    docs.write.parquet(path)
    docs = specs.sparkSession.read.schema(docs.schema).parquet(path)
    ports = _entries(docs, "doc.ports")
    uses = ports.select("product", "name", F.posexplode("entry.connections").alias("pos", "use"))
    return Catalog(
        products=docs.select("product", "head.info.*", F.col(f"head.{CORRUPT}").isNull().alias("readable")),
        tags=docs.select("product", F.posexplode_outer("doc.tags").alias("pos", "tag"))
        .where("pos is not null")
        .select("product", "pos", "tag.*"),
        connections=_entries(docs, "doc.connections").select(
            "product", "name", _given("entry.type"), _given("entry.host"), "entry.description", "entry.variables"
        ),
        ports=ports.select("product", "name", "entry.description", "entry.schema"),
        port_connections=uses.select(
            "product",
            F.col("name").alias("port"),
            "pos",
            _target(F.col("use.connection"), CONNECTION_PREFIX),
            "use.location",
        ),
        components=_entries(docs, "doc.components.schemas").withColumnRenamed("entry", "schema"),
    )


def _entries(docs: DataFrame, path: str) -> DataFrame:
    """A map of the document as rows of product, name and entry.

    Exploded as outer and then filtered: an inner explode adds a filter on the map's size
    below it, and with that parses each document more than once.
    """
    return docs.select("product", F.explode_outer(path).alias("name", "entry")).where("name is not null")


CORRUPT = "_corrupt"


def _head(text: Column) -> Column:
    """What a document says of itself, and the text if it is unreadable."""
    shape = f"info struct<title: string, version: string, description: string>, {CORRUPT} string"
    return F.from_json(text, shape, {"columnNameOfCorruptRecord": CORRUPT})


def _given(path: str) -> Column:
    """A part of an endpoint; endpoints that leave it out are alike in that."""
    return F.coalesce(F.col(path), F.lit("")).alias(path.rsplit(".", 1)[1])


def _target(reference: Column, prefix: str) -> Column:
    bare = F.when(reference.startswith(prefix), F.substring(reference, len(prefix) + 1, 1 << 30)).otherwise(reference)
    return bare.alias("connection")


def _as_json(text: Column, fmt: str) -> Column:
    if fmt == "json":
        return text
    if fmt != "yaml":
        raise ContractError(f"spec format {fmt!r} is not json or yaml")
    if yaml is None:
        raise ContractError("reading YAML specs needs the yaml package")
    return F.pandas_udf(yaml_as_json, "string")(text)


def yaml_as_json(texts: pd.Series) -> pd.Series:
    """YAML documents as JSON text, key order kept; unreadable ones stay as they are."""
    loader = _yaml_loader()

    def convert(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_parsed(text, loader))
        except Exception:  # whatever a document is made of, it is unreadable, and the others are not
            return text

    return texts.map(convert)


def read_spec(text: str) -> Any:
    """One spec document, JSON or YAML, as Python values."""
    return _parsed(text, _yaml_loader())


def _parsed(text: str, loader) -> Any:
    if text.lstrip().startswith("{"):
        try:
            return json.loads(text)
        except ValueError:
            pass  # a YAML flow mapping may look like this too
    if loader is None:
        raise ContractError("reading YAML specs needs the yaml package")
    try:
        return yaml.load(text, Loader=loader)
    except yaml.YAMLError as err:
        raise ContractError(f"the spec is not readable: {err}") from err


def _yaml_loader():
    """A safe loader in which only true and false are booleans and dates stay text."""
    if yaml is None:
        return None
    loader = type("SpecLoader", (getattr(yaml, "CSafeLoader", yaml.SafeLoader),), {})
    dropped = ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")
    loader.yaml_implicit_resolvers = {
        first: [(tag, pattern) for tag, pattern in resolvers if tag not in dropped]
        for first, resolvers in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    loader.add_implicit_resolver(dropped[0], BOOLEAN, list("tTfF"))
    return loader


# Rows a task holds before it hands them back.
FIELD_ROWS = 10_000

FIELD_CATALOG_TYPE = (
    "product string, port string, path string, type string, required boolean, "
    "description string, constraints string, error string"
)


def field_catalog(
    specs: DataFrame, product: str = "product", spec: str = "spec", fmt: str = "json", files: DataFrame | None = None
) -> DataFrame:
    """One row per leaf field of every port, compiled as for applying the contract.

    A port without schema has no rows; one whose schema cannot be compiled has a single row
    with ``error``. Elements of arrays of objects are listed under ``array[].field``. ``files`` (product, path, schema) are schema files
    that specs refer to by path, as JSON text; a product's files go to the compiler with its spec, so leave out those it does not reach
    (:func:`~tablepact.operators.references.reached_files`). Without it references to files are errors.
    """
    texts = specs.select(F.col(product).cast("string").alias("product"), _as_json(F.col(spec), fmt).alias("text"))
    if files is not None:
        held = files.groupBy(F.col("product").cast("string").alias("product")).agg(F.collect_list(F.struct("path", "schema")).alias("files"))
        texts = texts.join(held, "product", "left").withColumn("files", F.coalesce("files", F.array().cast("array<struct<path:string,schema:string>>")))
    return texts.mapInPandas(field_rows, FIELD_CATALOG_TYPE)


def field_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in FIELD_CATALOG_TYPE.split(", ")]
    for batch in batches:
        files = batch["files"] if "files" in batch else [None] * len(batch)
        texts = zip(batch["product"], batch["text"], files)
        rows = (row for product, text, held in texts for row in _spec_rows(product, text, held))
        while chunk := list(islice(rows, FIELD_ROWS)):
            yield pd.DataFrame(chunk, columns=columns)


def _file_schemas(files) -> dict[str, Any] | None:
    """Schemas by path; a file that cannot be read is no schema, which is an error where it is used."""
    if files is None:
        return None
    found = {}
    for held in files:
        try:
            found[held["path"]] = json.loads(held["schema"])
        except (TypeError, ValueError, RecursionError):
            found[held["path"]] = "unreadable"
    return found


def _spec_rows(product: str, text: str, files=None) -> Iterator[tuple]:
    schemas = _file_schemas(files)
    try:
        doc = json.loads(text)
        ports = dict(doc.get("ports") or {})
        components = (doc.get("components") or {}).get("schemas") or {}
    except (AttributeError, TypeError, ValueError, RecursionError):
        yield (product, None, None, None, None, None, None, "the spec is not readable")
        return
    for name, port in ports.items():
        try:
            schema = (port or {}).get("schema")
            leaves = [] if schema is None else Contract.from_schema(schema, name, components, schemas).leaves()
            rows = [
                (product, name, leaf.dotted, leaf.data_type.simpleString(), leaf.required, leaf.description,
                 constraint_text(leaf.constraints), None)
                for leaf in leaves
            ]
        except Exception as err:  # an odd schema is that port's error row
            yield (product, name, None, None, None, None, None, str(err) or type(err).__name__)
            continue
        yield from rows


def constraint_text(constraints) -> str:
    """Constraints as one line of text, in documentation order."""
    parts = []
    for keyword, value in constraints.items():
        if value is None or (keyword != "const" and value in ([], "")):
            continue
        if keyword == "enum":
            parts.append("enum: " + ", ".join(f"`{show(v)}`" for v in value))
        elif keyword in ("const", "pattern"):
            parts.append(f"{keyword}: `{show(value)}`")
        else:
            parts.append(f"{keyword}: {show(value)}")
    return ", ".join(parts)
