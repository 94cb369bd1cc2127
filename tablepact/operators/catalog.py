"""Questions about a catalog of specs, as relational queries.

Two connections with the same type and host are the same endpoint: a port that uses one
uses both. Usage is therefore keyed on (product, type, host), and each connection is looked
up by its endpoint. Bulk answers list an endpoint's users once, not once per connection of
that endpoint, so their size follows the data.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.functions.text import shortened
from tablepact.operators.joins import lookup
from tablepact.sources.specs import COMPONENT_PREFIX, Catalog

ENDPOINT = ["product", "type", "host"]

# Locations of a port whose texts one task joins at a time; the joined parts are then joined to the port's row.
PART_ENTRIES = 1000


def endpoint_uses(catalog: Catalog) -> DataFrame:
    """Every port location with the endpoint behind it: product, type, host, port, pos, location."""
    return lookup(catalog.port_connections, _endpoints(catalog), ["product", "connection"], "inner").select(
        *ENDPOINT, "port", "pos", "location"
    )


def endpoint_users(catalog: Catalog) -> DataFrame:
    """Which ports use which endpoint, each pair once."""
    return endpoint_uses(catalog).select(*ENDPOINT, "port").distinct()


def used_endpoints(catalog: Catalog) -> DataFrame:
    """The endpoints some port uses. References are made distinct before they are joined,
    within each task first, so a connection named by very many ports is shuffled as a few rows."""
    named = catalog.port_connections.select("product", "connection").distinct()
    return named.join(_endpoints(catalog), ["product", "connection"]).select(*ENDPOINT).distinct()


def _endpoints(catalog: Catalog) -> DataFrame:
    return catalog.connections.select("product", F.col("name").alias("connection"), "type", "host")


def port_locations(catalog: Catalog) -> DataFrame:
    """One row per location of a port: product, port, pos and entry, ``connection:location``.

    An endpoint is shown under the least of its connection names; a connection the product
    does not define is ``unknown``.
    """
    shown = catalog.connections.groupBy(*ENDPOINT).agg(F.min("name").alias("shown"))
    names = lookup(_endpoints(catalog), shown, ENDPOINT, "inner").select("product", "connection", "shown")
    entry = F.concat(F.coalesce("shown", F.lit("unknown")), F.lit(":"), F.coalesce("location", F.lit("")))
    return lookup(catalog.port_connections, names, ["product", "connection"]).select(
        "product", "port", "pos", entry.alias("entry")
    )


def port_listing(catalog: Catalog) -> DataFrame:
    """One row per port: its description, shortened, and its ``connection:location`` list, however long.

    The list is part of the row; its parts are joined apart from each other, so what is gathered
    for a port is a few texts. Sorted by product and name.
    """
    joined = lambda order, text: F.array_join(F.array_sort(F.collect_list(F.struct(order, text)))[text], ", ")
    lists = (
        port_locations(catalog)
        .groupBy("product", "port", F.floor(F.col("pos") / PART_ENTRIES).alias("part"))
        .agg(joined("pos", "entry").alias("entries"))
        .groupBy("product", "port")
        .agg(joined("part", "entries").alias("connections"))
        .withColumnRenamed("port", "name")
    )
    return (
        catalog.ports.join(lists, ["product", "name"], "left")
        .select(
            "product",
            "name",
            shortened(F.col("description"), 40).alias("description"),
            F.coalesce("connections", F.lit("-")).alias("connections"),
        )
        .orderBy("product", "name")
    )


def connection_usage(catalog: Catalog) -> DataFrame:
    """Per connection: how many ports use its endpoint, as a number and as text."""
    usage = endpoint_users(catalog).groupBy(*ENDPOINT).agg(F.count(F.lit(1)).alias("ports"))
    ports = F.coalesce("ports", F.lit(0))
    return lookup(catalog.connections, usage, ENDPOINT).select(
        "product",
        "name",
        "type",
        "host",
        shortened(F.col("description"), 30).alias("description"),
        ports.alias("ports"),
        _counted(ports).alias("used_by"),
    )


def _counted(ports: Column) -> Column:
    return F.when(ports == 0, "-").when(ports == 1, "1 port").otherwise(F.concat(ports.cast("string"), F.lit(" ports")))


def connection_variables(catalog: Catalog) -> DataFrame:
    """One row per variable of each connection."""
    return catalog.connections.select(
        "product", F.col("name").alias("connection"), "type", "host", F.explode("variables").alias("variable", "value")
    )


def connection_ports(catalog: Catalog) -> DataFrame:
    """One row per port location, with the endpoint it is at and the port's description."""
    ports = catalog.ports.select(
        "product", F.col("name").alias("port"), shortened(F.col("description"), 40).alias("description")
    )
    return lookup(endpoint_uses(catalog), ports, ["product", "port"]).select(
        *ENDPOINT, "port", "pos", "description", "location"
    )


def describe_connection(catalog: Catalog, product, name: str) -> tuple[DataFrame, DataFrame]:
    """The variables of one connection, and the port locations at its endpoint."""
    chosen = (F.col("product") == F.lit(product)) & (F.col("name") == name)
    connection = catalog.connections.where(chosen)
    variables = connection.select(F.explode("variables").alias("variable", "value")).orderBy("variable")
    ports = (
        connection_ports(catalog)
        .where(F.col("product") == F.lit(product))
        .join(connection.select(*ENDPOINT), ENDPOINT, "left_semi")
        .select("port", "description", "location")
        .orderBy("port")
    )
    return variables, ports


def connection_states(catalog: Catalog) -> DataFrame:
    """Every connection with ``used``: whether some port uses its endpoint."""
    used = used_endpoints(catalog).withColumn("used", F.lit(True))
    return lookup(catalog.connections, used, ENDPOINT).select(
        "product", F.col("name").alias("connection"), "type", "host", F.coalesce("used", F.lit(False)).alias("used")
    )


def removable_connections(catalog: Catalog) -> DataFrame:
    """Connections whose endpoint no port uses."""
    return connection_states(catalog).where("not used").drop("used")


def blocked_connections(catalog: Catalog) -> DataFrame:
    """Connections that are in use. Their users are the rows of :func:`endpoint_users`."""
    return connection_states(catalog).where("used").drop("used")


# Keywords whose values are data: what looks like a reference in them is none.
DATA_KEYWORDS = frozenset({"enum", "const", "default", "examples", "example"})

LOCAL_PREFIXES = ("#/$defs/", "#/definitions/")


def read_references(schema: str | None, parts: bool = False) -> list[tuple[str, str]]:
    """(kind, target) of the references of a JSON schema, each once: components, files (``parts``: with the
    part of the file), and local definitions it does not have, under either spelling. A schema that is no JSON has none."""
    try:
        root = json.loads(schema or "null")
    except (ValueError, RecursionError):
        return []
    found, open_nodes = {}, [root]
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, dict):
            ref = node.get("$ref")
            if isinstance(ref, str) and ref:
                local = next((p for p in LOCAL_PREFIXES if ref.startswith(p)), None)
                if ref.startswith(COMPONENT_PREFIX):
                    found["component", ref[len(COMPONENT_PREFIX) :]] = None
                elif local and not any(ref[len(local) :] in (root.get(p[2:-1]) or {}) for p in LOCAL_PREFIXES):
                    found["local", ref[len(local) :]] = None
                elif not ref.startswith("#"):
                    found["file", ref if parts else ref.partition("#")[0]] = None
            open_nodes += [v for k, v in node.items() if k not in DATA_KEYWORDS]
        elif isinstance(node, list):
            open_nodes += node
    return list(found)


REFERENCE_TYPE = "array<struct<kind: string, target: string>>"


def schema_references(schemas: DataFrame, owner: str) -> DataFrame:
    """product, ``owner``, kind, target: one row per reference of each named schema.

    Texts without the word are not parsed; the others are, once, in Arrow batches.
    """

    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [{"kind": kind, "target": target} for kind, target in read_references(text)])

    references = F.pandas_udf(read, REFERENCE_TYPE)(F.col("schema"))
    return schemas.where(F.contains("schema", F.lit("$ref"))).select(
        "product", F.col("name").alias(owner), F.inline(references)
    )


def port_references(catalog: Catalog) -> DataFrame:
    """product, port, component: shared schemas named in each port's own schema."""
    return referenced(catalog.ports, "port", "component")


def referenced(schemas: DataFrame, owner: str, target: str) -> DataFrame:
    """One row per shared schema that each named schema refers to."""
    found = schema_references(schemas, owner).where("kind = 'component'")
    return found.select("product", owner, F.col("target").alias(target))


def dangling_connections(catalog: Catalog) -> DataFrame:
    """product, port, target: connections that a port names and its product does not define, each once."""
    defined = catalog.connections.select("product", F.col("name").alias("connection"))
    named = catalog.port_connections.select("product", "port", "connection").distinct()
    return named.join(defined, ["product", "connection"], "left_anti").select("product", "port", F.col("connection").alias("target"))


def dangling_references(
    catalog: Catalog, references: DataFrame | None = None, files: DataFrame | None = None
) -> DataFrame:
    """Ports that name a connection, a schema or a file that is not there.

    ``references`` are the schemas each port uses: its direct ones, or those of
    :func:`~tablepact.operators.closure.schema_closure` to find breaks further down. ``files`` (product,
    path) are the schema files at hand; without it references to files are not judged. What shared schemas and files
    name themselves is judged by :func:`~tablepact.operators.references.broken_references`.
    """
    connections = dangling_connections(catalog).withColumn("reason", F.lit("connection not found"))
    own = schema_references(catalog.ports, "port")
    if references is None:
        wanted = own.where("kind in ('component', 'local')")
    else:
        further = references.distinct().select("product", "port", F.lit("component").alias("kind"), F.col("component").alias("target"))
        wanted = further.unionByName(own.where("kind = 'local'"))
    known = catalog.components.select("product", F.lit("component").alias("kind"), F.col("name").alias("target"))
    reason = F.when(F.col("kind") == "component", "schema not found").otherwise("definition not found")
    lost = wanted.join(known, ["product", "kind", "target"], "left_anti")
    found = connections.unionByName(lost.select("product", "port", "target", reason.alias("reason")))
    if files is None:
        return found
    held = files.select("product", F.col("path").alias("target"))
    named = own.where("kind = 'file'").withColumn("target", F.regexp_replace("target", r"^(?:\./)+", ""))
    gone = named.join(held, ["product", "target"], "left_anti")
    return found.unionByName(gone.select("product", "port", "target", F.lit("file not found").alias("reason")))


def local_definitions(schemas: DataFrame) -> DataFrame:
    """product, owner, name, schema: what each named schema defines for itself, under ``$defs`` or ``definitions``."""
    spelled = [F.from_json(F.get_json_object("schema", f"$.{prefix[2:-1]}"), "map<string, string>") for prefix in LOCAL_PREFIXES]
    entries = F.flatten(F.array(*[F.coalesce(F.map_entries(s), F.array()) for s in spelled]))
    held = schemas.where(F.contains("schema", F.lit("$defs")) | F.contains("schema", F.lit("definitions")))
    return held.select("product", F.col("name").alias("owner"), F.explode_outer(entries).alias("entry")).where("entry is not null").select(
        "product", "owner", F.col("entry.key").alias("name"), F.col("entry.value").alias("schema")
    )


def schema_definitions(catalog: Catalog) -> DataFrame:
    """Every place a schema gets a name: components, ports with a schema of their own, and what either defines for itself."""
    own = F.get_json_object("schema", "$.$ref").isNull() & F.col("schema").isNotNull()
    named = lambda df, origin: df.select("product", "name", "schema", F.lit(origin).alias("origin"))
    return (
        named(catalog.components, "component")
        .unionByName(named(catalog.ports.where(own), "port"))
        .unionByName(named(local_definitions(catalog.ports), "local"))
        .unionByName(named(local_definitions(catalog.components), "local"))
    )


def duplicate_names(catalog: Catalog) -> DataFrame:
    """Schema names a product defines more than once with different content.

    Local definitions, ``$defs`` or ``definitions``, of different ports and components may share a name; one that also names a component
    or a port's schema may not differ from it. Content is compared as JSON, so spacing and
    the order of keys make no difference.
    """
    content = F.coalesce(F.to_json(F.try_parse_json("schema")), F.col("schema"))
    return (
        schema_definitions(catalog)
        .select("product", "name", F.sha2(content, 256).alias("content"), (F.col("origin") != "local").alias("shared"))
        .groupBy("product", "name", "content")
        .agg(F.count(F.lit(1)).alias("uses"), F.bool_or("shared").alias("shared"))
        .groupBy("product", "name")
        .agg(
            F.count(F.lit(1)).alias("versions"),
            F.sum("uses").alias("definitions"),
            F.bool_or("shared").alias("shared"),
        )
        .where((F.col("versions") > 1) & F.col("shared"))
        .drop("shared")
    )
