"""References between the schemas of a catalog: ports, shared schemas, and schema files.

A schema file is a row of ``files`` (product, path, schema): JSON or YAML text, under the path by which the product's spec
names it. References to paths are relative to the file that makes them. What a port uses is what can be
reached from its own schema, through shared schemas and files alike.
"""

from __future__ import annotations

import json
import posixpath
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.operators.catalog import dangling_connections, local_definitions, read_references
from tablepact.operators.closure import reachable
from tablepact.sources.scratch import stored
from tablepact.sources.specs import Catalog, yaml_as_json

PORT, COMPONENT, FILE, LOCAL, INSIDE = "port", "component", "file", "local", "inside"

EDGE_TYPE = "array<struct<kind: string, target: string>>"


def edges_of(schema: str | None, base: str) -> list[tuple[str, str]]:
    """(kind, target) of the references of a schema that stands in the folder of ``base``.

    Files go by their path from the root; a reference to a part of a file is one to the file, and one of kind ``inside``.
    """
    references = read_references(schema, parts=True)
    found = dict.fromkeys(e for e in references if e[0] != FILE)
    for kind, target in references:
        if kind == FILE:
            path, mark, inside = target.partition("#")
            path = posixpath.normpath(posixpath.join(posixpath.dirname(base), path))
            found[FILE, path] = None
            if inside.strip("/"):
                found[INSIDE, f"{path}{mark}{inside}"] = None
    return list(found)


def schema_edges(catalog: Catalog, files: DataFrame | None = None) -> DataFrame:
    """product, owner_kind, owner, kind, target: one row per reference of each port, shared schema and file.

    Texts without the word are not parsed; the others are, once, and the rows are a table in shared storage.
    """
    return _edges(catalog, readable_files(files) if files is not None and "schema" in files.columns else None)


def _edges(catalog: Catalog, texts: DataFrame | None) -> DataFrame:
    """As ``schema_edges``, from the texts of the files as JSON."""
    named = lambda df, kind, name: df.select("product", F.lit(kind).alias("owner_kind"), F.col(name).alias("owner"), F.col("schema"))
    parts = [named(catalog.ports, PORT, "name"), named(catalog.components, COMPONENT, "name")]
    if texts is not None:
        parts.append(named(texts, FILE, "path"))
    schemas = reduce(DataFrame.unionByName, parts).where(F.contains("schema", F.lit("$ref")))

    def read(texts: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "target": t} for k, t in edges_of(*pair)] for pair in zip(texts, bases)], dtype=object)

    base = F.when(F.col("owner_kind") == FILE, F.col("owner")).otherwise("")
    edges = schemas.select("product", "owner_kind", "owner", F.inline(F.pandas_udf(read, EDGE_TYPE)(F.col("schema"), base)))
    return stored(edges, "references")


def readable_files(files: DataFrame) -> DataFrame:
    """Schema files by normal paths, with their text as JSON where it can be read."""
    return files.select("product", _normal(F.col("path")).alias("path"), F.pandas_udf(yaml_as_json, "string")(F.col("schema")).alias("schema"))


def _normal(path):
    return F.regexp_replace(path, r"^(?:\./)+", "")


def _node(kind, target):
    return F.concat(kind, F.lit(" "), target)


def schema_uses(edges: DataFrame) -> DataFrame:
    """product, port, kind, target: every shared schema and file that each port reaches. Cycles are safe.

    ``edges`` are those of :func:`schema_edges`.
    """
    linked = edges.where(F.col("kind").isin(COMPONENT, FILE)).withColumn("next", _node(F.col("kind"), F.col("target")))
    own = linked.where(F.col("owner_kind") == PORT).select("product", F.col("owner").alias("port"), F.col("next").alias("root"))
    onward = linked.where(F.col("owner_kind") != PORT).select("product", _node(F.col("owner_kind"), F.col("owner")).alias("component"), "next")
    reached = reachable(own.select("product", "root").distinct(), onward)
    kind = F.substring_index("component", " ", 1)
    target = F.expr("substring(component, length(substring_index(component, ' ', 1)) + 2)")
    return own.join(reached, ["product", "root"]).select("product", "port", kind.alias("kind"), target.alias("target")).distinct()


def reached_files(catalog: Catalog, files: DataFrame) -> DataFrame:
    """The rows of ``files`` that some port of their product reaches, by normal paths and as JSON text."""
    texts = stored(readable_files(files), "files")
    used = schema_uses(_edges(catalog, texts)).where(F.col("kind") == FILE).select("product", F.col("target").alias("path")).distinct()
    return texts.join(used, ["product", "path"], "left_semi")


def broken_references(catalog: Catalog, files: DataFrame | None = None) -> DataFrame:
    """product, port, target, reason: every port that names, or reaches, something that is not there; each break once per port.

    Judged are connections, shared schemas, local definitions (of the port, of shared schemas and of files), and with ``files`` also files and
    parts of files. Without the texts of the files (a column ``schema``) what they refer to is not judged. A local
    definition counts as there if the schema that names it has it, under either spelling, or the port has, or a shared schema is called so.
    """
    texts = stored(readable_files(files), "files") if files is not None and "schema" in files.columns else None
    edges = _edges(catalog, texts)
    uses = stored(schema_uses(edges), "uses")
    row = lambda df, reason: df.select("product", "port", "target", F.lit(reason).alias("reason"))
    names = catalog.components.select("product", F.col("name").alias("target"))
    lost = uses.where(F.col("kind") == COMPONENT).join(names, ["product", "target"], "left_anti")
    breaks = edges.where(F.col("kind").isin(LOCAL, INSIDE))
    own = breaks.where(F.col("owner_kind") == PORT).select("product", F.col("owner").alias("port"), "kind", "target")
    further = breaks.where(F.col("owner_kind") != PORT).select(
        "product", F.col("owner_kind").alias("via"), F.col("owner").alias("through"), F.col("kind").alias("found"), F.col("target").alias("named")
    )
    behind = uses.join(
        further, (uses["product"] == further["product"]) & (uses["kind"] == further["via"]) & (uses["target"] == further["through"])
    ).select(uses["product"], "port", F.col("found").alias("kind"), F.col("named").alias("target"))
    judged = own.unionByName(behind).distinct()
    held = local_definitions(catalog.ports).select("product", F.col("owner").alias("port"), F.col("name").alias("target"))
    local = judged.where(F.col("kind") == LOCAL).join(names, ["product", "target"], "left_anti").join(held, ["product", "port", "target"], "left_anti")
    found = row(dangling_connections(catalog), "connection not found").unionByName(row(lost, "schema not found"))
    found = found.unionByName(row(local, "definition not found"))
    if files is None:
        return found
    paths = files.select("product", _normal(F.col("path")).alias("target"))
    found = found.unionByName(row(uses.where(F.col("kind") == FILE).join(paths, ["product", "target"], "left_anti"), "file not found"))
    if texts is None:
        return found
    parts = judged.where(F.col("kind") == INSIDE)
    asked = parts.withColumn("file", F.substring_index("target", "#", 1)).join(texts.withColumnRenamed("path", "file"), ["product", "file"])
    has = F.pandas_udf(lambda text, ref: pd.Series([holds(*pair) for pair in zip(text, ref)], dtype=bool), "boolean")
    return found.unionByName(row(asked.where(~has(F.col("schema"), F.col("target"))), "definition not found"))


def holds(schema: str | None, reference: str) -> bool:
    """Whether a file has the part that a reference names after ``#``."""
    try:
        node = json.loads(schema or "null")
    except (ValueError, RecursionError):
        return False
    for part in [p for p in reference.partition("#")[2].split("/") if p]:
        node = node.get(part) if isinstance(node, dict) else None
    return node is not None
