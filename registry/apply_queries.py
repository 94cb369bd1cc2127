"""Queries of group A: contracts applied to data, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.check_queries import ORDER_DATE, ORDER_TIME, contract
from registry.common import Query, source, table
from tablepact import Contract, Port, apply_contract, parse_payload, parse_rows, read_port, run_ports, snake_case_columns, write_port
from tablepact.sources.scratch import scratch_path

PROJECTED = contract(
    "orders",
    {"o_totalprice": {"type": "number"}, "o_orderkey": {"type": "integer"}, "o_orderstatus": {"type": "string"}},
)

PRIMITIVES_AS_TEXT = source(
    "orders",
    "o_orderkey",
    "case when o_orderkey % 11 = 0 then 'n/a' else cast(o_custkey as string) end as customer",
    "case when o_orderkey % 13 = 0 then 'free' else cast(o_totalprice as string) end as price",
    "case when o_orderkey % 3 = 0 then 'true' when o_orderkey % 3 = 1 then 'false' else 'maybe' end as paid",
    "o_custkey as reference",
)
PRIMITIVES = contract(
    "orders",
    {
        "o_orderkey": {"type": "integer"},
        "customer": {"type": "integer"},
        "price": {"type": "number"},
        "paid": {"type": "boolean"},
        "reference": {"type": "string"},
    },
)

TEMPORAL_AS_TEXT = source("orders", "o_orderkey", ORDER_DATE, ORDER_TIME, "o_orderdate as stamp", "o_orderdate as day")
TEMPORAL = contract(
    "orders",
    {
        "o_orderkey": {"type": "integer"},
        "order_date": {"type": "string", "format": "date"},
        "order_time": {"type": "string", "format": "date-time"},
        "stamp": {"type": "string", "format": "date-time"},
        "day": {"type": "integer", "format": "date"},
    },
)

EMBEDDING = contract(
    "embeddings", {"vec_id": {"type": "integer"}, "embedding": {"type": "array", "items": {"type": "number"}}}
)

ORDER_PAYLOAD = Contract.from_schema(
    {
        "type": "object",
        "properties": {
            "order": {
                "type": "object",
                "properties": {
                    "key": {"type": "integer"},
                    "total": {"type": "number"},
                    "customer": {"$ref": "#/$defs/Customer"},
                },
            }
        },
        "$defs": {
            "Customer": {"type": "object", "properties": {"id": {"type": "integer"}, "segment": {"type": "string"}}}
        },
    },
    "order_payload",
)

LINES_PAYLOAD = contract(
    "lines_payload",
    {
        "lines": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {"part": {"type": "integer"}, "qty": {"type": "number"}, "flag": {"type": "string"}},
            },
        }
    },
)

DESCRIBED = contract(
    "customer",
    {
        "c_custkey": {"type": "integer", "description": "Customer number"},
        "c_name": {"type": "string", "description": "Customer's name"},
        "c_acctbal": {"type": "number", "description": "Account balance"},
    },
)

CUSTOMER_PORT = Contract.from_schema(
    {
        "type": "object",
        "description": "Customers by number",
        "required": ["c_custkey"],
        "properties": {
            "c_custkey": {"type": "integer", "description": "Customer number"},
            "c_name": {"type": "string"},
            "c_acctbal": {"type": "number"},
            "c_mktsegment": {"type": "string"},
        },
    },
    "customer",
)


def cast_primitive(spark, folder):
    typed = apply_contract(PRIMITIVES_AS_TEXT.frame(spark, folder), PRIMITIVES)
    # Booleans and, below, dates are compared by their text, which all clients print alike.
    return typed.withColumn("paid", F.col("paid").cast("string"))


def cast_temporal(spark, folder):
    typed = apply_contract(TEMPORAL_AS_TEXT.frame(spark, folder), TEMPORAL)
    # Instants leave as wall-clock time of the session, so that no time zone enters the result.
    shown = {c: F.col(c).cast("timestamp_ntz") for c in ("order_time", "stamp")}
    return typed.withColumns({**shown, **{c: F.col(c).cast("string") for c in ("order_date", "day")}})


def array(spark, folder):
    typed = apply_contract(table(spark, folder, "embeddings"), EMBEDDING)
    return typed.select("vec_id", F.posexplode("embedding").alias("pos", "value"))


def struct(spark, folder):
    orders = table(spark, folder, "orders")
    customer = F.when(
        F.col("o_orderkey") % 9 != 0,
        F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("segment")),
    )
    order = F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), customer.alias("customer")
    )
    texts = orders.select("o_orderkey", F.to_json(F.struct(order.alias("order"))).alias("payload"))
    return parse_payload(texts, "payload", ORDER_PAYLOAD).select(
        "o_orderkey",
        F.col("payload.order.key").alias("key"),
        F.col("payload.order.total").alias("total"),
        F.col("payload.order.customer.id").alias("customer_id"),
        F.col("payload.order.customer.segment").alias("segment"),
    )


def array_struct(spark, folder):
    line = F.struct(
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")
    )
    supply = F.struct(F.col("l_suppkey").alias("part"), F.lit("many").alias("qty"), F.lit("S").alias("flag"))
    texts = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit('{"lines":['), F.to_json(line), F.lit(","), F.to_json(supply), F.lit("]}")).alias("payload"),
    )
    return parse_rows(texts, "payload", LINES_PAYLOAD, "lines")


def table_sink(spark, folder):
    path = scratch_path(spark, "customer-port")
    name = "customer_port_" + path.rsplit("-", 1)[1]
    write_port(table(spark, folder, "customer"), CUSTOMER_PORT, name, path)
    return spark.table(name)


def file_source(spark, folder):
    customers = table(spark, folder, "customer").select(*CUSTOMER_PORT.column_names)
    read = []
    for fmt in ("parquet", "orc", "json", "csv"):
        path = scratch_path(spark, f"customer-{fmt}")
        customers.write.option("header", "true").format(fmt).save(path)
        read.append(read_port(spark, CUSTOMER_PORT, path, fmt).select(F.lit(fmt).alias("format"), "*"))
    return read[0].union(read[1]).union(read[2]).union(read[3])


def snake_case(spark, folder):
    customers = table(spark, folder, "customer").toDF("Cust-Key", "Customer  Name", "1st.Nation", "AcctBal", "_segment_")
    return snake_case_columns(customers)


def multi_port(spark, folder):
    ports = {
        "customers": Port(table(spark, folder, "customer"), CUSTOMER_PORT),
        "suppliers": Port(
            table(spark, folder, "supplier"),
            contract("suppliers", {"s_suppkey": {"type": "integer"}, "s_name": {"type": "string"}}),
        ),
        "parts": Port(table(spark, folder, "part"), None),
    }
    return run_ports(ports)


CUSTOMER_SELECT = "c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"

QUERIES: dict[str, Query] = {
    "contract_project": Query(
        lambda spark, folder: apply_contract(table(spark, folder, "orders"), PROJECTED),
        "SELECT o_totalprice, o_orderkey, o_orderstatus FROM orders",
    ),
    "contract_cast_primitive": Query(
        cast_primitive,
        f"""SELECT o_orderkey, try_cast(customer AS BIGINT) AS customer, try_cast(price AS DOUBLE) AS price,
            CAST(try_cast(paid AS BOOLEAN) AS VARCHAR) AS paid, CAST(reference AS VARCHAR) AS reference
        FROM ({PRIMITIVES_AS_TEXT.sql})""",
    ),
    "contract_cast_temporal": Query(
        cast_temporal,
        f"""SELECT o_orderkey, CAST(try_cast(order_date AS DATE) AS VARCHAR) AS order_date,
            try_cast(order_time AS TIMESTAMP) AS order_time, CAST(stamp AS TIMESTAMP) AS stamp,
            CAST(CAST(day AS DATE) AS VARCHAR) AS day
        FROM ({TEMPORAL_AS_TEXT.sql})""",
    ),
    "contract_array": Query(
        array,
        """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
            CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""",
    ),
    "contract_struct": Query(
        struct,
        """WITH payloads AS (
            SELECT o_orderkey, json_object('order', json_object('key', o_orderkey, 'total', o_totalprice, 'customer',
                CASE WHEN o_orderkey % 9 <> 0 THEN json_object('id', o_custkey, 'segment', o_orderpriority) END))
                AS payload FROM orders)
        SELECT o_orderkey, CAST(json_extract(payload, '$.order.key') AS BIGINT) AS key,
            CAST(json_extract(payload, '$.order.total') AS DOUBLE) AS total,
            CAST(json_extract(payload, '$.order.customer.id') AS BIGINT) AS customer_id,
            json_extract_string(payload, '$.order.customer.segment') AS segment FROM payloads""",
    ),
    "contract_array_struct": Query(
        array_struct,
        """SELECT l_orderkey, l_linenumber, l_partkey AS part, l_quantity AS qty, l_returnflag AS flag FROM lineitem
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_suppkey AS part, CAST(NULL AS DOUBLE) AS qty, 'S' AS flag FROM lineitem""",
    ),
    "contract_comments": Query(
        lambda spark, folder: apply_contract(table(spark, folder, "customer"), DESCRIBED),
        "SELECT c_custkey, c_name, c_acctbal FROM customer",
    ),
    "contract_table_sink": Query(table_sink, f"SELECT {CUSTOMER_SELECT}"),
    "contract_file_source": Query(
        file_source,
        "\nUNION ALL\n".join(
            f"SELECT '{fmt}' AS format, {CUSTOMER_SELECT}" for fmt in ("parquet", "orc", "json", "csv")
        ),
    ),
    "snake_case_columns": Query(
        snake_case,
        """SELECT c_custkey AS cust_key, c_name AS customer_name, c_nationkey AS _1st_nation,
            c_acctbal AS acctbal, c_mktsegment AS segment FROM customer""",
    ),
    "multi_port_run": Query(
        multi_port,
        f"""SELECT 'customers' AS port, c_custkey, c_name, c_acctbal, c_mktsegment,
            CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name FROM customer
        UNION ALL
        SELECT 'suppliers' AS port, NULL, NULL, NULL, NULL, s_suppkey, s_name FROM supplier""",
    ),
}
