"""Queries of group C: check sets over tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.check_queries import ORDER_DATE, contract
from registry.common import Query, source, summary_sql, table
from tablepact import (
    Port,
    annotate,
    enforce,
    enforce_stream,
    enforce_stream_tables,
    enforce_tables,
    parsed_records,
    read_summary,
    split,
    summarise,
    summarise_port_streams,
    summarise_ports,
    violations,
)
from tablepact.sources.scratch import scratch_path

LINEITEM = contract(
    "lineitem",
    {
        "l_orderkey": {"type": "integer"},
        "l_linenumber": {"type": "integer", "minimum": 1, "maximum": 6},
        "l_quantity": {"type": "number", "minimum": 5, "maximum": 45},
        "l_extendedprice": {"type": "number", "exclusiveMinimum": 1000},
        "l_discount": {"type": "number", "exclusiveMinimum": 0, "maximum": 0.09},
        "l_tax": {"type": "number", "exclusiveMaximum": 0.08},
        "l_returnflag": {"type": "string", "enum": ["A", "N"]},
        "l_linestatus": {"type": "string", "pattern": "^[FO]$"},
    },
    required=("l_orderkey",),
)
LINEITEM_BROKEN = [
    ("is_not_null", "l_orderkey", "l_orderkey IS NULL"),
    ("is_in_range", "l_linenumber", "l_linenumber NOT BETWEEN 1 AND 6"),
    ("is_in_range", "l_quantity", "l_quantity NOT BETWEEN 5 AND 45"),
    ("exclusive_minimum", "l_extendedprice", "l_extendedprice <= 1000"),
    ("is_not_greater_than", "l_discount", "l_discount > CAST(0.09 AS DOUBLE)"),
    ("exclusive_minimum", "l_discount", "l_discount <= 0"),
    ("exclusive_maximum", "l_tax", "l_tax >= CAST(0.08 AS DOUBLE)"),
    ("is_in_list", "l_returnflag", "l_returnflag NOT IN ('A', 'N')"),
    ("regex_match", "l_linestatus", "NOT regexp_matches(l_linestatus, '^[FO]$')"),
]

# Orders as they might arrive: some values as text, some unreadable, some missing.
RAW_ORDERS = source(
    "orders",
    "o_orderkey",
    "case when o_orderkey % 11 = 0 then 'n/a' else cast(o_custkey as string) end as custkey",
    "o_orderstatus",
    "o_totalprice",
    ORDER_DATE,
    "nullif(o_orderpriority, '4-NOT SPECIFIED') as priority",
)
ORDERS = contract(
    "orders",
    {
        "o_orderkey": {"type": "integer"},
        "custkey": {"type": "integer"},
        "o_orderstatus": {"type": "string", "enum": ["F", "O"]},
        "o_totalprice": {"type": "number", "maximum": 400000},
        "order_date": {"type": "string", "format": "date"},
        "priority": {"type": "string", "maxLength": 8},
    },
    required=("o_orderkey", "custkey", "priority"),
)
ORDERS_BROKEN = [
    ("is_not_null", "o_orderkey", "o_orderkey must not be null", "o_orderkey IS NULL"),
    ("is_not_null", "custkey", "custkey must not be null", "try_cast(custkey AS BIGINT) IS NULL"),
    (
        "is_in_list",
        "o_orderstatus",
        "o_orderstatus must be in the allowed values",
        "o_orderstatus NOT IN ('F', 'O')",
    ),
    ("is_not_greater_than", "o_totalprice", "o_totalprice must not be greater than 400000", "o_totalprice > 400000"),
    ("is_valid_date", "order_date", "order_date must be a valid date", "try_cast(order_date AS DATE) IS NULL"),
    ("is_not_null", "priority", "priority must not be null", "priority IS NULL"),
    ("max_length", "priority", "priority must have maximum length of 8", "length(priority) > 8"),
]
ANY_BROKEN = " OR ".join(f"coalesce({broken}, false)" for *_, broken in ORDERS_BROKEN)
BROKEN_COUNT = " + ".join(f"(CASE WHEN {broken} THEN 1 ELSE 0 END)" for *_, broken in ORDERS_BROKEN)
BROKEN_NAMES = ", ".join(
    f"CASE WHEN {broken} THEN '{rule}:{column}:{message}' END" for rule, column, message, broken in ORDERS_BROKEN
)

EVENTS = contract(
    "events",
    {
        "event_id": {"type": "integer"},
        "ts": {"type": "string", "format": "date-time"},
        "event_type": {"type": "string", "enum": ["click", "view", "purchase", "signup"]},
        "value": {"type": "number", "maximum": 100},
    },
    required=("event_id", "event_type"),
)
EVENTS_CHECKS = [
    ("is_not_null", "event_id", "event_id IS NULL"),
    ("is_valid_timestamp", "ts", "false"),
    ("is_not_null", "event_type", "event_type IS NULL"),
    ("is_in_list", "event_type", "event_type NOT IN ('click', 'view', 'purchase', 'signup')"),
    ("is_not_greater_than", "value", "value > 100"),
]
EVENTS_BROKEN = "event_type NOT IN ('click', 'view', 'purchase', 'signup') OR value > 100"

PORTS = {
    "lines": ("lineitem", LINEITEM, LINEITEM_BROKEN),
    "customers": (
        "customer",
        contract("customers", {"c_acctbal": {"type": "number", "minimum": 0}}),
        [("is_not_less_than", "c_acctbal", "c_acctbal < 0")],
    ),
    "parts": (
        "part",
        contract("parts", {"p_size": {"type": "integer", "multipleOf": 5}, "p_name": {"maxLength": 10}}),
        [("multiple_of", "p_size", "p_size % 5 <> 0"), ("max_length", "p_name", "length(p_name) > 10")],
    ),
}


def joined_errors(df):
    named = F.transform("_errors", lambda e: F.concat_ws(":", e.check, e.column, e.message))
    return df.select("o_orderkey", F.size("_errors").alias("n_errors"), F.array_join(named, ",").alias("errors"))


def sides(spark, folder):
    valid, quarantine = split(RAW_ORDERS.frame(spark, folder), ORDERS)
    return valid.select(F.lit("valid").alias("side"), "o_orderkey", "custkey", F.lit(0).alias("n_errors")).unionByName(
        quarantine.select(
            F.lit("quarantine").alias("side"), "o_orderkey", "custkey", F.size("_errors").alias("n_errors")
        )
    )


def stored_sides(spark, folder):
    good, bad = scratch_path(spark, "orders-good"), scratch_path(spark, "orders-bad")
    enforce(RAW_ORDERS.frame(spark, folder), ORDERS, good, bad)
    kept = spark.read.parquet(good).select(
        F.lit("good").alias("side"),
        "o_orderkey",
        "custkey",
        F.lit(None).cast("string").alias("raw"),
        F.col("order_date").cast("string").alias("order_date"),
    )
    lost = spark.read.parquet(bad).select(
        F.lit("bad").alias("side"),
        "o_orderkey",
        F.lit(None).cast("bigint").alias("custkey"),
        F.col("custkey").alias("raw"),
        F.lit(None).cast("string").alias("order_date"),
    )
    return kept.unionByName(lost).unionByName(repeated_run(spark, folder))


def repeated_run(spark, folder):
    """Both tables after a run that was done twice."""
    path = scratch_path(spark, "orders-runs")
    good, bad = (f"orders_{side}_{path.rsplit('-', 1)[1]}" for side in ("good", "bad"))
    for _ in range(2):
        enforce_tables(RAW_ORDERS.frame(spark, folder), ORDERS, good, bad, run="first", location=path)
    none = F.lit(None).cast("string")
    kept = spark.table(good).select(F.lit("good table").alias("side"), "o_orderkey", "custkey", none.alias("raw"), none.alias("order_date"))
    lost = spark.table(bad).select(
        F.lit("bad table").alias("side"), "o_orderkey", F.lit(None).cast("bigint").alias("custkey"), F.col("custkey").alias("raw"), none.alias("order_date")
    )
    return kept.unionByName(lost)


def streamed_sides(spark, folder):
    good, bad = scratch_path(spark, "events-good"), scratch_path(spark, "events-bad")
    enforce_stream(event_stream(spark, folder), EVENTS, good, bad, scratch_path(spark, "events-progress")).awaitTermination()
    columns = ["event_id", "event_type", "value"]
    return (
        spark.read.parquet(good)
        .select(F.lit("good").alias("side"), *columns)
        .unionByName(spark.read.parquet(bad).select(F.lit("bad").alias("side"), *columns))
        .unionByName(payload_sides(spark, folder))
    )


def event_stream(spark, folder):
    # As a pattern the path may name one file or a folder of files; as a name, only a folder.
    return spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events[.]parquet")


# Events as records on a message bus: a key, and a payload in bytes, some of them cut off.
PROPS = contract("props", {"k": {"type": "integer", "maximum": 50}}, required=("k",))
CUT = "CASE WHEN event_id % 50 = 0 THEN substring(props, 1, 3) ELSE props END"
PROPS_SQL = f"""SELECT event_id, CASE WHEN json_valid(cut) THEN CAST(json_extract_string(cut, '$.k') AS BIGINT) END AS k
    FROM (SELECT event_id, {CUT} AS cut FROM events)"""


def payload_sides(spark, folder):
    """The payload port's rows by side, in tables: k as text where it can be read."""
    path = scratch_path(spark, "props")
    good, bad = (f"props_{side}_{path.rsplit('-', 1)[1]}" for side in ("good", "bad"))
    bus = event_stream(spark, folder).selectExpr("event_id", f"cast({CUT} as binary) as value")
    enforce_stream_tables(parsed_records(bus, "value", PROPS), PROPS, good, bad, f"{path}/progress", location=path).awaitTermination()
    none = F.lit(None)
    kept = spark.table(good).select(
        F.lit("payload good").alias("side"), none.cast("bigint").alias("event_id"), F.col("k").cast("string").alias("event_type"), none.cast("double").alias("value")
    )
    reasons = F.array_join(F.transform("_errors", lambda e: e["check"]), ",")
    lost = spark.table(bad).select(F.lit("payload bad").alias("side"), "event_id", reasons.alias("event_type"), none.cast("double").alias("value"))
    return kept.unionByName(lost)


def port_summaries(spark, folder):
    """The summary of every port, and the running totals of the events as a streaming port."""
    batch = summarise_ports({name: Port(table(spark, folder, origin), rules) for name, (origin, rules, _) in PORTS.items()})
    path = scratch_path(spark, "port-totals")
    streams = {"events": Port(event_stream(spark, folder), EVENTS), "plain": Port(event_stream(spark, folder), None)}
    for query in summarise_port_streams(streams, f"{path}/totals", f"{path}/progress").values():
        query.awaitTermination()
    return batch.unionByName(read_summary(spark, f"{path}/totals", ports=True).drop("stream"))


QUERIES: dict[str, Query] = {
    "annotate_violations": Query(
        lambda spark, folder: joined_errors(annotate(RAW_ORDERS.frame(spark, folder), ORDERS)),
        f"""SELECT o_orderkey, CAST({BROKEN_COUNT} AS INTEGER) AS n_errors, concat_ws(',', {BROKEN_NAMES}) AS errors
        FROM ({RAW_ORDERS.sql})""",
    ),
    "split_valid_quarantine": Query(
        sides,
        f"""SELECT CASE WHEN {ANY_BROKEN} THEN 'quarantine' ELSE 'valid' END AS side, o_orderkey, custkey,
            CAST({BROKEN_COUNT} AS INTEGER) AS n_errors FROM ({RAW_ORDERS.sql})""",
    ),
    "violation_summary": Query(
        lambda spark, folder: summarise(table(spark, folder, "lineitem"), LINEITEM),
        summary_sql("SELECT * FROM lineitem", LINEITEM_BROKEN),
    ),
    "violations_long": Query(
        lambda spark, folder: violations(RAW_ORDERS.frame(spark, folder), ORDERS, "o_orderkey"),
        "\nUNION ALL\n".join(
            f"""SELECT o_orderkey, '{rule}' AS "check", '{column}' AS "column", '{message}' AS message
            FROM ({RAW_ORDERS.sql}) WHERE {broken}"""
            for rule, column, message, broken in ORDERS_BROKEN
        ),
    ),
    "no_checks_passthrough": Query(
        lambda spark, folder: annotate(
            table(spark, folder, "customer"), contract("customer", {"c_name": {"type": "string"}})
        ).withColumn("_errors", F.size("_errors")),
        "SELECT *, CAST(0 AS INTEGER) AS _errors FROM customer",
    ),
    "enforce_and_write": Query(
        stored_sides,
        f"""SELECT CASE WHEN {ANY_BROKEN} THEN 'bad' ELSE 'good' END AS side, o_orderkey,
            CASE WHEN NOT ({ANY_BROKEN}) THEN try_cast(custkey AS BIGINT) END AS custkey,
            CASE WHEN {ANY_BROKEN} THEN custkey END AS raw,
            CASE WHEN NOT ({ANY_BROKEN}) THEN CAST(try_cast(order_date AS DATE) AS VARCHAR) END AS order_date
        FROM ({RAW_ORDERS.sql})
        UNION ALL SELECT 'good table', o_orderkey, try_cast(custkey AS BIGINT), NULL, NULL FROM ({RAW_ORDERS.sql}) WHERE NOT ({ANY_BROKEN})
        UNION ALL SELECT 'bad table', o_orderkey, NULL, custkey, NULL FROM ({RAW_ORDERS.sql}) WHERE {ANY_BROKEN}""",
    ),
    "stream_enforce": Query(
        streamed_sides,
        f"""SELECT CASE WHEN {EVENTS_BROKEN} THEN 'bad' ELSE 'good' END AS side, event_id, event_type, value
        FROM events
        UNION ALL SELECT 'payload good', NULL, CAST(k AS VARCHAR), NULL FROM ({PROPS_SQL}) WHERE k <= 50
        UNION ALL SELECT 'payload bad', event_id, CASE WHEN k IS NULL THEN 'is_not_null,is_readable' ELSE 'is_not_greater_than' END, NULL
        FROM ({PROPS_SQL}) WHERE k IS NULL OR k > 50""",
    ),
    "multi_port_quality": Query(
        port_summaries,
        "\nUNION ALL\n".join(
            summary_sql(f"SELECT * FROM {origin}", broken, first=f"'{name}' AS port, ")
            for name, (origin, _, broken) in (*PORTS.items(), ("events", ("events", EVENTS, EVENTS_CHECKS)))
        ),
    ),
}
