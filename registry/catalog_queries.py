"""Queries of group D: catalogs of specs.

The corpus has one spec document per customer (and, for YAML, per supplier), rendered from
that row alone: three connections, of which two may share an endpoint, three ports, and
shared schemas, some missing, some defined twice. A second corpus has one document per part, with schemas in files of its own.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry.common import Query, dealt, table
from tablepact.operators import catalog as C
from tablepact.operators.closure import schema_closure
from tablepact.operators.references import broken_references, reached_files
from tablepact.sources.specs import Catalog, field_catalog, parse_catalog

PRODUCT = "concat('product_', cast(c_custkey as string))"
NATION = "cast(c_nationkey as string)"
KIND = "case c_nationkey % 3 when 0 then 'postgresql' when 1 then 'kafka' else 's3' end"
MIRROR_HOST = f"case when c_custkey % 2 = 0 then concat('host-', {NATION}) else concat('mirror-', {NATION}) end"
SECOND = "case when c_custkey % 5 = 0 then 'gone' else 'mirror' end"
HOME = "case when c_custkey % 7 = 0 then 'Missing' else 'Address' end"
LOCAL_LENGTH = "case when c_custkey % 6 = 0 then '5' else '3' end"
LENGTH = "cast(10 + c_nationkey as string)"

# {name} stands for a value of the row; everything else is the document's text.
SPEC = (
    '{"info":{"title":"{title}","version":"1.0.{nation}","description":"{segment}"},'
    '"tags":[{"name":"{segment}","description":"segment"},{"name":"nation"}],'
    '"connections":{'
    '"main":{"type":"{kind}","host":"host-{nation}","description":"{title} main store for everything",'
    '"variables":{"schema":"{segment}","retries":{nation}}},'
    '"mirror":{"type":"{kind}","host":"{mirror}","description":"copy"},'
    '"archive":{"type":"tape","host":"archive-{nation}"}},'
    '"ports":{'
    '"accounts":{"description":"Accounts of {title} in segment {segment}",'
    '"connections":[{"connection":"#/connections/main","location":"accounts_{nation}"},'
    '{"connection":"#/connections/{second}","location":"copy"}],'
    '"schema":{"$ref":"#/components/schemas/Account"}},'
    '"segments":{"description":"","connections":[{"connection":"#/connections/mirror","location":"{segment}"}],'
    '"schema":{"type":"object","required":["name"],"properties":{'
    '"name":{"type":"string","description":"Segment name","maxLength":{length},"enum":["a","b"]},'
    '"home":{"$ref":"#/components/schemas/{home}"},"mark":{"$ref":"#/$defs/Mark"}},'
    '"$defs":{"Mark":{"type":"string","minLength":{local}}}}},'
    '"bare":{"description":"{segment}","connections":[]}},'
    '"components":{"schemas":{'
    '"Account":{"type":"object","properties":{"id":{"type":"integer","minimum":0},'
    '"address":{"$ref":"#/components/schemas/Address"}}},'
    '"Address":{"type":"object","required":["street"],"properties":{"street":{"type":"string","pattern":"^[A-Z]"},'
    '"lines":{"type":"array","items":{"type":"object","properties":{"no":{"type":"integer"}}},"maxItems":3}}},'
    '"Mark":{"type":"string","minLength":3}}}}'
)
SPEC_VALUES = {
    "title": "c_name",
    "nation": NATION,
    "segment": "c_mktsegment",
    "kind": KIND,
    "mirror": MIRROR_HOST,
    "second": SECOND,
    "home": HOME,
    "local": LOCAL_LENGTH,
    "length": LENGTH,
}

YAML_SPEC = """# a supplier's product
info: {title: "{name}", version: "2.{nation}", description: off}
tags:
  - name: supplier
connections:
  depot:
    type: kafka
    host: depot-{nation}:9092
    variables: {since: 2024-01-01, secure: true, topics: [a, b]}
ports:
  stock:
    description: Stock of {name}
    connections:
      - connection: "#/connections/depot"
        location: stock
    schema:
      type: object
      properties: {item: {type: string}}
"""
YAML_VALUES = {"name": "s_name", "nation": "cast(s_nationkey as string)"}

PART = "concat('part_', cast(p_partkey as string))"
FILE_SPEC = (
    '{"info":{"title":"{name}","version":"1.0.0"},"connections":{},"ports":{'
    '"goods":{"description":"in files","connections":[],"schema":{"$ref":"./schemas/goods.json"}},'
    '"boxes":{"description":"two shared schemas deep","connections":[],"schema":{"type":"object",'
    '"properties":{"label":{"$ref":"#/components/schemas/Label"}},"definitions":{"{own}":{"type":"integer"}}}}},'
    '"components":{"schemas":{'
    '"Label":{"type":"object","properties":{"tag":{"$ref":"#/components/schemas/Tag"}},"$defs":{"{inner}":{"type":"string"}}},'
    '"Tag":{"type":"object","properties":{"code":{"$ref":"schemas/codes.yaml#/$defs/{code}"},"mark":{"$ref":"#/$defs/{mark}"}},'
    '"$defs":{"Mark":{"type":"string","maxLength":{size}}}}}}}'
)
FILE_VALUES = {
    "name": "p_name",
    "size": "cast(p_size as string)",
    "own": "case when p_partkey % 3 = 0 then 'Tag' else 'Other' end",
    "inner": "case when p_partkey % 4 = 0 then 'Label' else 'Inner' end",
    "code": "case when p_partkey % 13 = 0 then 'Lost' else 'Code' end",
    "mark": "case when p_partkey % 5 = 0 then 'Nope' else 'Mark' end",
    "brand": "p_brand",
}
# Path of each schema file, its text, and the parts whose product has it.
SCHEMA_FILES = [
    ("./schemas/goods.json", '{"type":"object","required":["id"],"properties":{"id":{"type":"integer"},'
     '"brand":{"type":"string","const":"{brand}"},"box":{"$ref":"box.json"}}}', "true"),
    ("schemas/box.json", '{"type":"object","properties":{"width":{"type":"number","minimum":{size}},'
     '"lid":{"$ref":"../schemas/codes.yaml#/$defs/Code"}}}', "p_partkey % 7 <> 0"),
    ("schemas/codes.yaml", "$defs:\n  Code: {type: string, pattern: '^[A-Z]'}\n  Loop: {$ref: goods.json}\n", "p_partkey % 11 <> 0"),
    ("schemas/unused.json", '{"$ref":"nowhere.json"}', "true"),
]


def rendered(template: str, values: dict[str, str]):
    """A text column: the template with each ``{name}`` replaced by its value's expression."""
    pieces = re.split("({(?:" + "|".join(values) + ")})", template)
    return F.concat(*[F.expr(values[p[1:-1]]) if p[1:-1] in values else F.lit(p) for p in pieces if p])


def corpus(spark, folder) -> DataFrame:
    customers = dealt(table(spark, folder, "customer"))
    return customers.select(F.expr(PRODUCT).alias("product"), rendered(SPEC, SPEC_VALUES).alias("spec"))


def file_corpus(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Specs of parts, and the schema files they refer to."""
    parts = dealt(table(spark, folder, "part"))
    product = F.expr(PART).alias("product")
    files = [
        parts.where(there).select(product, F.lit(path).alias("path"), rendered(text, FILE_VALUES).alias("schema"))
        for path, text, there in SCHEMA_FILES
    ]
    return parts.select(product, rendered(FILE_SPEC, FILE_VALUES).alias("spec")), reduce(DataFrame.unionByName, files)


def catalog(spark, folder) -> Catalog:
    return parse_catalog(corpus(spark, folder))


def yaml_catalog(spark, folder) -> Catalog:
    suppliers = dealt(table(spark, folder, "supplier"))
    name = F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string"))
    specs = suppliers.select(name.alias("product"), rendered(YAML_SPEC, YAML_VALUES).alias("spec"))
    return parse_catalog(specs, fmt="yaml")


def entities(c: Catalog) -> DataFrame:
    """All catalog tables as one list."""

    def rows(df: DataFrame, entity: str, name, a, b) -> DataFrame:
        texts = [F.col(name), F.expr(a).cast("string"), F.expr(b).cast("string")]
        return df.select(F.lit(entity).alias("entity"), "product", *[t.alias(n) for t, n in zip(texts, "nab")])

    parts = [
        rows(c.products.where("readable"), "product", "title", "version", "description"),
        rows(c.tags, "tag", "name", "pos", "description"),
        rows(c.connections, "connection", "name", "concat(type, '@', host)", "description"),
        rows(C.connection_variables(c), "variable", "connection", "variable", "value"),
        rows(c.ports, "port", "name", "description", "schema is not null"),
        rows(c.port_connections, "use", "port", "concat(pos, ':', connection)", "location"),
        rows(c.components, "component", "name", "length(schema)", "null"),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def parsed(spark, folder):
    return entities(catalog(spark, folder)).unionByName(entities(yaml_catalog(spark, folder)))


# The same catalog in SQL.
CATALOG_SQL = f"""WITH base AS (
    SELECT *, {PRODUCT} AS product, {NATION} AS nation, {KIND} AS kind, {MIRROR_HOST} AS mirror_host,
        {SECOND} AS second, {HOME} AS home, {LOCAL_LENGTH} AS local_length, {LENGTH} AS length FROM customer),
connections AS (
    SELECT product, 'main' AS name, kind AS type, concat('host-', nation) AS host,
        concat(c_name, ' main store for everything') AS description FROM base
    UNION ALL SELECT product, 'mirror', kind, mirror_host, 'copy' FROM base
    UNION ALL SELECT product, 'archive', 'tape', concat('archive-', nation), NULL FROM base),
variables AS (
    SELECT product, 'main' AS connection, 'schema' AS variable, c_mktsegment AS value FROM base
    UNION ALL SELECT product, 'main', 'retries', nation FROM base),
ports AS (
    SELECT product, 'accounts' AS name, concat('Accounts of ', c_name, ' in segment ', c_mktsegment) AS description
        FROM base
    UNION ALL SELECT product, 'segments', '' FROM base
    UNION ALL SELECT product, 'bare', c_mktsegment FROM base),
uses AS (
    SELECT product, 'accounts' AS port, 0 AS pos, 'main' AS connection, concat('accounts_', nation) AS location
        FROM base
    UNION ALL SELECT product, 'accounts', 1, second, 'copy' FROM base
    UNION ALL SELECT product, 'segments', 0, 'mirror', c_mktsegment FROM base),
endpoint_uses AS (
    SELECT u.product, c.type, c.host, u.port, u.pos, u.location
    FROM uses u JOIN connections c ON u.product = c.product AND u.connection = c.name)
"""

SHORT_40 = """CASE WHEN coalesce(description, '') = '' THEN '-'
    WHEN length(description) > 40 THEN concat(substring(description, 1, 37), '...') ELSE description END"""
SHORT_30 = """CASE WHEN coalesce(description, '') = '' THEN '-'
    WHEN length(description) > 30 THEN concat(substring(description, 1, 27), '...') ELSE description END"""

PARSED_SQL = (
    CATALOG_SQL
    + """, suppliers AS (SELECT *, concat('supplier_', CAST(s_suppkey AS VARCHAR)) AS product,
        CAST(s_nationkey AS VARCHAR) AS nation FROM supplier)
SELECT 'product' AS entity, product, c_name AS n, concat('1.0.', nation) AS a, c_mktsegment AS b FROM base
UNION ALL SELECT 'tag', product, c_mktsegment, '0', 'segment' FROM base
UNION ALL SELECT 'tag', product, 'nation', '1', NULL FROM base
UNION ALL SELECT 'connection', product, name, concat(type, '@', host), description FROM connections
UNION ALL SELECT 'variable', product, connection, variable, value FROM variables
UNION ALL SELECT 'port', product, name, description, CASE WHEN name = 'bare' THEN 'false' ELSE 'true' END FROM ports
UNION ALL SELECT 'use', product, port, concat(CAST(pos AS VARCHAR), ':', connection), location FROM uses
UNION ALL SELECT 'component', product, 'Account', '118', NULL FROM base
UNION ALL SELECT 'component', product, 'Address', '203', NULL FROM base
UNION ALL SELECT 'component', product, 'Mark', '31', NULL FROM base
UNION ALL SELECT 'product', product, s_name, concat('2.', nation), 'off' FROM suppliers
UNION ALL SELECT 'tag', product, 'supplier', '0', NULL FROM suppliers
UNION ALL SELECT 'connection', product, 'depot', concat('kafka@depot-', nation, ':9092'), NULL FROM suppliers
UNION ALL SELECT 'variable', product, 'depot', 'since', '2024-01-01' FROM suppliers
UNION ALL SELECT 'variable', product, 'depot', 'secure', 'true' FROM suppliers
UNION ALL SELECT 'variable', product, 'depot', 'topics', '["a","b"]' FROM suppliers
UNION ALL SELECT 'port', product, 'stock', concat('Stock of ', s_name), 'true' FROM suppliers
UNION ALL SELECT 'use', product, 'stock', '0:depot', 'stock' FROM suppliers"""
)

ADDRESS_FIELDS = [
    ("street", "string", "true", "", "pattern: `^[A-Z]`"),
    ("lines", "array<struct<no:bigint>>", "false", "", "maxItems: 3"),
    ("lines[].no", "bigint", "false", "", ""),
]


def field_sql(port: str, path: str, kind: str, required: str, description: str, constraints: str, where: str) -> str:
    return f"""SELECT product, '{port}' AS port, '{path}' AS path, '{kind}' AS type, '{required}' AS required,
        '{description}' AS description, {constraints} AS constraints, CAST(NULL AS VARCHAR) AS error
    FROM base WHERE {where}"""


FIELDS_SQL = CATALOG_SQL + "\nUNION ALL\n".join(
    [field_sql("accounts", "id", "bigint", "false", "", "'minimum: 0'", "true")]
    + [
        field_sql("accounts", f"address.{path}", kind, required, description, f"'{text}'", "true")
        for path, kind, required, description, text in ADDRESS_FIELDS
    ]
    + [
        field_sql("segments", "name", "string", "true", "Segment name",
                  "concat('enum: `a`, `b`, maxLength: ', length)", "home = 'Address'"),
        field_sql("segments", "mark", "string", "false", "", "concat('minLength: ', local_length)", "home = 'Address'"),
    ]
    + [
        field_sql("segments", f"home.{path}", kind, required, description, f"'{text}'", "home = 'Address'")
        for path, kind, required, description, text in ADDRESS_FIELDS
    ]
    + [
        """SELECT product, 'segments', NULL, NULL, NULL, NULL, NULL, 'referenced schema ''Missing'' not found'
        FROM base WHERE home = 'Missing'"""
    ]
)


def part_field_sql(port: str, path: str, kind: str, required: str, constraints: str, where: str) -> str:
    return f"""SELECT {PART}, '{port}', '{path}', '{kind}', '{required}', '', {constraints}, NULL FROM part WHERE {where}"""


def part_error_sql(port: str, error: str, where: str) -> str:
    return f"""SELECT {PART}, '{port}', NULL, NULL, NULL, NULL, NULL, '{error.replace("'", "''")}' FROM part WHERE {where}"""


GOODS, BOXES = "p_partkey % 7 <> 0 AND p_partkey % 11 <> 0", "p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0"
FIELDS_SQL += "\nUNION ALL\n" + "\nUNION ALL\n".join([
    part_field_sql("goods", "id", "bigint", "true", "''", GOODS),
    part_field_sql("goods", "brand", "string", "false", "concat('const: `', p_brand, '`')", GOODS),
    part_field_sql("goods", "box.width", "double", "false", "concat('minimum: ', CAST(p_size AS VARCHAR))", GOODS),
    part_field_sql("goods", "box.lid", "string", "false", "'pattern: `^[A-Z]`'", GOODS),
    part_field_sql("boxes", "label.tag.code", "string", "false", "'pattern: `^[A-Z]`'", BOXES),
    part_field_sql("boxes", "label.tag.mark", "string", "false", "concat('maxLength: ', CAST(p_size AS VARCHAR))", BOXES),
    part_error_sql("goods", "file 'schemas/box.json' not found", "p_partkey % 7 = 0"),
    part_error_sql("goods", "file 'schemas/codes.yaml' not found", "p_partkey % 7 <> 0 AND p_partkey % 11 = 0"),
    part_error_sql("boxes", "file 'schemas/codes.yaml' not found", "p_partkey % 11 = 0"),
    part_error_sql("boxes", "'schemas/codes.yaml#/$defs/Lost' is not in file 'schemas/codes.yaml'", "p_partkey % 11 <> 0 AND p_partkey % 13 = 0"),
    part_error_sql("boxes", "referenced schema 'Nope' not found", "p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 5 = 0"),
])


def fields(spark, folder):
    """Fields of the specs of customers, and of those of parts, whose schemas are in files."""
    specs, files = file_corpus(spark, folder)
    own = field_catalog(specs, files=reached_files(parse_catalog(specs), files))
    return field_catalog(corpus(spark, folder)).unionByName(own).withColumn("required", F.col("required").cast("string"))


def breaks(spark, folder):
    """What specs of customers name in vain, and what those of parts reach in vain."""
    specs, files = file_corpus(spark, folder)
    return C.dangling_references(catalog(spark, folder)).unionByName(broken_references(parse_catalog(specs), files))


def conflicts(spark, folder):
    specs, _ = file_corpus(spark, folder)
    return C.duplicate_names(catalog(spark, folder)).unionByName(C.duplicate_names(parse_catalog(specs)))


def connection_details(spark, folder):
    """Variables and port locations in one list."""
    c = catalog(spark, folder)
    variables = C.connection_variables(c).select(
        F.lit("variable").alias("entry"), "product", "type", "host",
        F.col("connection").alias("name"), F.col("variable").alias("detail"), F.col("value"),
    )
    ports = C.connection_ports(c).select(
        F.lit("port").alias("entry"), "product", "type", "host",
        F.col("port").alias("name"), F.col("description").alias("detail"), F.col("location").alias("value"),
    )
    return variables.unionByName(ports)


def removal(spark, folder):
    """Every connection with whether it can go, and the users of each endpoint."""
    c = catalog(spark, folder)
    state = F.when(F.col("used"), "blocked").otherwise("removable").alias("entry")
    states = C.connection_states(c).select("product", "connection", "type", "host", state)
    users = C.endpoint_users(c).withColumn("entry", F.lit("user")).withColumnRenamed("port", "connection")
    return states.unionByName(users).withColumnRenamed("connection", "name")


def part_graph(spark, folder) -> Catalog:
    """Every part is a shared schema that refers to the part of half its number; 1 and 7 close a cycle."""
    parts = dealt(table(spark, folder, "part"))
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    target = F.when(F.col("p_partkey") == 1, 7).otherwise(F.floor(F.col("p_partkey") / 2))
    schema = F.concat(
        F.lit('{"type":"object","properties":{"next":{"$ref":"#/components/schemas/p'),
        target.cast("string"),
        F.lit('"}}}'),
    )
    ports = parts.select(
        F.lit("parts").alias("product"),
        F.concat(F.lit("port_"), F.col("p_partkey").cast("string")).alias("name"),
        F.lit("").alias("description"),
        F.concat(F.lit('{"$ref":"#/components/schemas/'), name, F.lit('"}')).alias("schema"),
    )
    components = parts.select(F.lit("parts").alias("product"), name.alias("name"), schema.alias("schema"))
    return Catalog(None, None, None, ports, None, components)


QUERIES: dict[str, Query] = {
    "catalog_parse": Query(parsed, PARSED_SQL),
    "field_catalog": Query(fields, FIELDS_SQL),
    "port_listing": Query(
        lambda spark, folder: C.port_listing(catalog(spark, folder)),
        f"""{CATALOG_SQL}, named AS (
            SELECT c.product, c.name AS connection, s.shown FROM connections c JOIN (
                SELECT product, type, host, min(name) AS shown FROM connections GROUP BY ALL) s
            ON c.product = s.product AND c.type = s.type AND c.host = s.host),
        lists AS (
            SELECT u.product, u.port AS name,
                string_agg(concat(coalesce(n.shown, 'unknown'), ':', u.location), ', ' ORDER BY u.pos) AS connections
            FROM uses u LEFT JOIN named n ON u.product = n.product AND u.connection = n.connection GROUP BY ALL)
        SELECT p.product, p.name, {SHORT_40} AS description, coalesce(l.connections, '-') AS connections
        FROM ports p LEFT JOIN lists l ON p.product = l.product AND p.name = l.name""",
    ),
    "connection_usage": Query(
        lambda spark, folder: C.connection_usage(catalog(spark, folder)),
        f"""{CATALOG_SQL}, usage AS (
            SELECT product, type, host, count(DISTINCT port) AS ports FROM endpoint_uses GROUP BY ALL)
        SELECT c.product, c.name, c.type, c.host, {SHORT_30} AS description, coalesce(u.ports, 0) AS ports,
            CASE coalesce(u.ports, 0) WHEN 0 THEN '-' WHEN 1 THEN '1 port'
                ELSE concat(CAST(u.ports AS VARCHAR), ' ports') END AS used_by
        FROM connections c LEFT JOIN usage u ON c.product = u.product AND c.type = u.type AND c.host = u.host""",
    ),
    "connection_ports": Query(
        connection_details,
        f"""{CATALOG_SQL}
        SELECT 'variable' AS entry, v.product, c.type, c.host, v.connection AS name, v.variable AS detail, v.value
        FROM variables v JOIN connections c ON v.product = c.product AND v.connection = c.name
        UNION ALL
        SELECT 'port', e.product, e.type, e.host, e.port, {SHORT_40}, e.location
        FROM endpoint_uses e JOIN ports p ON e.product = p.product AND e.port = p.name""",
    ),
    "removable_connections": Query(
        removal,
        f"""{CATALOG_SQL}
        SELECT c.product, c.name, c.type, c.host, CASE WHEN EXISTS (SELECT 1 FROM endpoint_uses e
            WHERE e.product = c.product AND e.type = c.type AND e.host = c.host)
            THEN 'blocked' ELSE 'removable' END AS entry FROM connections c
        UNION ALL SELECT DISTINCT product, port, type, host, 'user' FROM endpoint_uses""",
    ),
    "dangling_references": Query(
        breaks,
        f"""{CATALOG_SQL}
        SELECT product, 'accounts' AS port, second AS target, 'connection not found' AS reason
        FROM base WHERE second = 'gone'
        UNION ALL SELECT product, 'segments', home, 'schema not found' FROM base WHERE home = 'Missing'
        UNION ALL SELECT {PART}, 'goods', 'schemas/box.json', 'file not found' FROM part WHERE p_partkey % 7 = 0
        UNION ALL SELECT {PART}, 'goods', 'schemas/codes.yaml', 'file not found' FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 7 <> 0
        UNION ALL SELECT {PART}, 'boxes', 'schemas/codes.yaml', 'file not found' FROM part WHERE p_partkey % 11 = 0
        UNION ALL SELECT {PART}, 'boxes', 'schemas/codes.yaml#/$defs/Lost', 'definition not found' FROM part
            WHERE p_partkey % 13 = 0 AND p_partkey % 11 <> 0
        UNION ALL SELECT {PART}, 'boxes', 'schemas/box.json', 'file not found' FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 11 <> 0
        UNION ALL SELECT {PART}, 'boxes', 'Nope', 'definition not found' FROM part WHERE p_partkey % 5 = 0""",
    ),
    "duplicate_names": Query(
        conflicts,
        f"""{CATALOG_SQL}, marks AS (
            SELECT product, 'Mark' AS name, '3' AS content FROM base
            UNION ALL SELECT product, 'Mark', local_length FROM base)
        SELECT product, name, count(DISTINCT content) AS versions, count(*) AS definitions
        FROM marks GROUP BY product, name HAVING count(DISTINCT content) > 1
        UNION ALL SELECT {PART}, 'Tag', 2, 2 FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT {PART}, 'Label', 2, 2 FROM part WHERE p_partkey % 4 = 0""",
    ),
    "schema_ref_closure": Query(
        lambda spark, folder: schema_closure(part_graph(spark, folder)),
        """WITH RECURSIVE edges AS (
            SELECT p_partkey AS a, CASE WHEN p_partkey = 1 THEN 7 ELSE p_partkey // 2 END AS b FROM part),
        reached AS (
            SELECT p_partkey AS root, p_partkey AS component FROM part
            UNION SELECT r.root, e.b FROM reached r JOIN edges e ON r.component = e.a)
        SELECT 'parts' AS product, concat('port_', CAST(root AS VARCHAR)) AS port,
            concat('p', CAST(component AS VARCHAR)) AS component FROM reached""",
    ),
}
