"""One query per row check: rows seen and violations on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import Query, source, summary_sql, table
from tablepact import Contract, summarise


def contract(name: str, properties: dict, required: tuple[str, ...] = ()) -> Contract:
    return Contract.from_schema({"type": "object", "required": list(required), "properties": properties}, name)


def check_query(origin, properties: dict, broken: list[tuple[str, str, str]], required=(), expression=None) -> Query:
    rules = contract(origin.table, properties, required)
    if expression:
        rules = rules.with_expression(expression)
    return Query(lambda spark, folder: summarise(origin.frame(spark, folder), rules), summary_sql(origin.sql, broken))


ORDER_DATE = """case when o_orderkey % 7 = 0 then 'not-a-date'
    else cast(cast(o_orderdate as date) as string) end as order_date"""
ORDER_TIME = "case when o_orderkey % 7 = 0 then 'not-a-time' else cast(o_orderdate as string) end as order_time"
PRIORITY = "nullif(o_orderpriority, '4-NOT SPECIFIED') as priority"
IPV4 = "concat(cast(o_custkey % 300 as string), '.1.2.3') as address"
IPV6 = """concat(
    case o_orderkey % 9
        when 0 then '1:2:3:4:5:6:7:' when 1 then '::' when 2 then '1:2:3:4:5:6::' when 3 then '2001:DB8:0:0:0:0:'
        when 4 then 'fe80::1::' when 5 then '1:2:3:4:5:6:7:8:' when 6 then ':::' else '2001:db8::' end,
    cast(o_orderkey % 10000 as string),
    case when o_orderkey % 5 = 0 then 'g' when o_orderkey % 11 = 0 then '::' when o_orderkey % 13 = 0 then 'abc' else '' end
    ) as address"""
UUID = """concat('00000000-0000-4000-8000-',
    lpad(cast(o_orderkey as string), case when o_orderkey % 6 = 0 then 11 else 12 end, '0')) as id"""
EMAIL = """concat('user', cast(c_custkey as string),
    case when c_custkey % 4 = 0 then '@example' else '@example.com' end) as email"""
WORDS = "split(text, ' ') as words"
QUOTED = "concat('it', chr(39), 's ', chr(92), ' ', p_type) as label"


# What a valid address, number or name is, said without the patterns that are tested.
VALID_IPV4 = """len(string_split(address, '.')) = 4 AND list_bool_and(list_transform(string_split(address, '.'),
    lambda o: length(o) BETWEEN 1 AND 3 AND coalesce(TRY_CAST(o AS INTEGER) BETWEEN 0 AND 255, false)))"""
VALID_IPV6 = """len(string_split(address, '::')) <= 2
    AND list_bool_and(list_transform(string_split(address, '::'), lambda p: NOT starts_with(p, ':') AND NOT ends_with(p, ':')))
    AND list_bool_and(list_transform(list_filter(string_split(address, ':'), lambda g: g <> ''),
        lambda g: length(g) <= 4 AND trim(lower(g), '0123456789abcdef') = ''))
    AND CASE WHEN contains(address, '::') THEN len(list_filter(string_split(address, ':'), lambda g: g <> '')) <= 7
        ELSE len(string_split(address, ':')) = 8 END"""
VALID_UUID = """list_transform(string_split(id, '-'), lambda g: length(g)) = [8, 4, 4, 4, 12]
    AND trim(lower(replace(id, '-', '')), '0123456789abcdef') = ''"""
VALID_EMAIL = """len(string_split(email, '@')) = 2 AND string_split(email, '@')[1] <> ''
    AND trim(lower(string_split(email, '@')[1]), 'abcdefghijklmnopqrstuvwxyz0123456789._%+-') = ''
    AND len(string_split(string_split(email, '@')[2], '.')) >= 2 AND length(string_split(email, '.')[-1]) >= 2
    AND trim(lower(string_split(email, '.')[-1]), 'abcdefghijklmnopqrstuvwxyz') = ''"""


def not_matching(column: str, pattern: str) -> str:
    return f"NOT regexp_matches({column}, '{pattern}')"


def nested_path(spark, folder):
    """Rules on leaves of nested objects, one of them under a name with a dot."""
    c = table(spark, folder, "customer")
    profile = F.struct(
        F.col("c_mktsegment").alias("segment"),
        F.struct(F.col("c_acctbal").alias("acct.bal"), F.col("c_name").alias("holder`s")).alias("account"),
    )
    nested = c.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, profile).alias("profile"))
    rules = contract(
        "customer",
        {
            "profile": {
                "type": "object",
                "required": ["segment"],
                "properties": {
                    "segment": {"type": "string", "enum": ["BUILDING", "HOUSEHOLD"]},
                    "account": {
                        "type": "object",
                        "required": ["holder`s"],
                        "properties": {
                            "acct.bal": {"type": "number", "minimum": 0},
                            "holder`s": {"type": "string"},
                        },
                    },
                },
            }
        },
        required=("profile",),
    )
    return summarise(nested, rules)


QUERIES: dict[str, Query] = {
    "check_is_not_null": check_query(
        source("orders", "o_orderkey", PRIORITY),
        {"o_orderkey": {"type": "integer"}, "priority": {"type": "string"}},
        [("is_not_null", "o_orderkey", "o_orderkey IS NULL"), ("is_not_null", "priority", "priority IS NULL")],
        required=("o_orderkey", "priority"),
    ),
    "check_is_in_list": check_query(
        source("orders", "o_orderstatus"),
        {"o_orderstatus": {"type": "string", "enum": ["F", "O"]}},
        [("is_in_list", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')")],
    ),
    "check_is_equal_to": check_query(
        source("customer", "c_mktsegment"),
        {"c_mktsegment": {"type": "string", "const": "BUILDING"}},
        [("is_equal_to", "c_mktsegment", "c_mktsegment <> 'BUILDING'")],
    ),
    "check_is_in_range": check_query(
        source("lineitem", "l_quantity"),
        {"l_quantity": {"type": "number", "minimum": 5, "maximum": 45}},
        [("is_in_range", "l_quantity", "l_quantity NOT BETWEEN 5 AND 45")],
    ),
    "check_is_not_less_than": check_query(
        source("customer", "c_acctbal"),
        {"c_acctbal": {"type": "number", "minimum": 0}},
        [("is_not_less_than", "c_acctbal", "c_acctbal < 0")],
    ),
    "check_is_not_greater_than": check_query(
        source("orders", "o_totalprice"),
        {"o_totalprice": {"type": "number", "maximum": 400000}},
        [("is_not_greater_than", "o_totalprice", "o_totalprice > 400000")],
    ),
    "check_exclusive_minimum": check_query(
        source("lineitem", "l_discount"),
        {"l_discount": {"type": "number", "exclusiveMinimum": 0}},
        [("exclusive_minimum", "l_discount", "l_discount <= 0")],
    ),
    "check_exclusive_maximum": check_query(
        source("lineitem", "l_tax"),
        {"l_tax": {"type": "number", "exclusiveMaximum": 0.08}},
        [("exclusive_maximum", "l_tax", "l_tax >= CAST(0.08 AS DOUBLE)")],
    ),
    "check_min_length": check_query(
        source("documents", "text"),
        {"text": {"type": "string", "minLength": 100}},
        [("min_length", "text", "length(text) < 100")],
    ),
    "check_max_length": check_query(
        source("part", "p_name"),
        {"p_name": {"type": "string", "maxLength": 10}},
        [("max_length", "p_name", "length(p_name) > 10")],
    ),
    "check_regex_match": check_query(
        source("part", "p_brand"),
        {"p_brand": {"type": "string", "pattern": "#[0-9]$"}},
        [("regex_match", "p_brand", not_matching("p_brand", "#[0-9]$"))],
    ),
    "check_multiple_of": check_query(
        source("part", "p_size", "p_retailprice"),
        {"p_size": {"type": "integer", "multipleOf": 5}, "p_retailprice": {"type": "number", "multipleOf": 5}},
        [
            ("multiple_of", "p_size", "p_size % 5 <> 0"),
            ("multiple_of", "p_retailprice", "p_retailprice % 5 <> 0"),
        ],
    ),
    "check_min_items": check_query(
        source("documents", WORDS),
        {"words": {"type": "array", "items": {"type": "string"}, "minItems": 20}},
        [("min_items", "words", "len(words) < 20")],
    ),
    "check_max_items": check_query(
        source("documents", WORDS),
        {"words": {"type": "array", "items": {"type": "string"}, "maxItems": 500}},
        [("max_items", "words", "len(words) > 500")],
    ),
    "check_valid_date": check_query(
        source("orders", ORDER_DATE),
        {"order_date": {"type": "string", "format": "date"}},
        [("is_valid_date", "order_date", "try_cast(order_date AS DATE) IS NULL")],
    ),
    "check_valid_timestamp": check_query(
        source("orders", ORDER_TIME),
        {"order_time": {"type": "string", "format": "date-time"}},
        [("is_valid_timestamp", "order_time", "try_cast(order_time AS TIMESTAMP) IS NULL")],
    ),
    "check_valid_ipv4": check_query(
        source("orders", IPV4),
        {"address": {"type": "string", "format": "ipv4"}},
        [("is_valid_ipv4_address", "address", f"NOT ({VALID_IPV4})")],
    ),
    "check_valid_ipv6": check_query(
        source("orders", IPV6),
        {"address": {"type": "string", "format": "ipv6"}},
        [("is_valid_ipv6_address", "address", f"NOT ({VALID_IPV6})")],
    ),
    "check_uuid": check_query(
        source("orders", UUID),
        {"id": {"type": "string", "format": "uuid"}},
        [("is_uuid", "id", f"NOT ({VALID_UUID})")],
    ),
    "check_email": check_query(
        source("customer", EMAIL),
        {"email": {"type": "string", "format": "email"}},
        [("is_email", "email", f"NOT ({VALID_EMAIL})")],
    ),
    "check_sql_expression": check_query(
        source("lineitem", "l_extendedprice", "l_quantity"),
        {},
        [("sql_expression", "", "NOT (l_extendedprice >= l_quantity * 900)")],
        expression="l_extendedprice >= l_quantity * 900",
    ),
    "check_null_safe": check_query(
        source("orders", PRIORITY, "nullif(o_orderstatus, 'P') as status", "nullif(o_custkey, 1) as custkey"),
        {
            "priority": {"type": "string", "pattern": "^[12]-", "maxLength": 7},
            "status": {"type": "string", "const": "F"},
            "custkey": {"type": "integer", "minimum": 10},
        },
        [
            ("max_length", "priority", "priority IS NOT NULL AND length(priority) > 7"),
            ("regex_match", "priority", "priority IS NOT NULL AND " + not_matching("priority", "^[12]-")),
            ("is_equal_to", "status", "status IS NOT NULL AND status <> 'F'"),
            ("is_not_less_than", "custkey", "custkey IS NOT NULL AND custkey < 10"),
        ],
    ),
    "check_nested_path": Query(
        nested_path,
        summary_sql(
            """SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment,
                CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS balance,
                CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS holder FROM customer""",
            [
                ("is_not_null", "profile.segment", "segment IS NULL"),
                ("is_in_list", "profile.segment", "segment NOT IN ('BUILDING', 'HOUSEHOLD')"),
                ("is_not_less_than", "profile.account.acct.bal", "balance < 0"),
                ("is_not_null", "profile.account.holder`s", "holder IS NULL"),
            ],
        ),
    ),
    "check_combined_order": check_query(
        source("part", "p_size", "nullif(p_brand, 'Brand#3') as brand"),
        {
            "p_size": {
                "type": "integer",
                "multipleOf": 2,
                "exclusiveMaximum": 45,
                "exclusiveMinimum": 3,
                "maximum": 48,
                "minimum": 2,
                "enum": [2, 4, 6, 8, 10, 20, 30, 40, 50],
            },
            "brand": {"type": "string", "pattern": "[0-5]$", "maxLength": 7, "minLength": 7, "const": "Brand#4"},
        },
        [
            ("is_not_null", "p_size", "p_size IS NULL"),
            ("is_in_list", "p_size", "p_size NOT IN (2, 4, 6, 8, 10, 20, 30, 40, 50)"),
            ("is_in_range", "p_size", "p_size NOT BETWEEN 2 AND 48"),
            ("exclusive_minimum", "p_size", "p_size <= 3"),
            ("exclusive_maximum", "p_size", "p_size >= 45"),
            ("multiple_of", "p_size", "p_size % 2 <> 0"),
            ("is_not_null", "brand", "brand IS NULL"),
            ("is_equal_to", "brand", "brand <> 'Brand#4'"),
            ("min_length", "brand", "length(brand) < 7"),
            ("max_length", "brand", "length(brand) > 7"),
            ("regex_match", "brand", not_matching("brand", "[0-5]$")),
        ],
        required=("p_size", "brand"),
    ),
    "check_typed_literals": check_query(
        source(
            "part",
            "p_size",
            "cast(p_size as string) as size_text",
            "case when p_size > 25 then 'true' else 'True' end as flag",
            QUOTED,
        ),
        {
            "p_size": {"type": "integer", "enum": [1, 2.0, "3", True, None]},
            "size_text": {"type": "string", "const": "7"},
            "flag": {"type": "string", "const": "true"},
            "label": {"type": "string", "enum": ["it's \\ ECONOMY", "it's \\ STANDARD", 7]},
        },
        [
            ("is_in_list", "p_size", "p_size NOT IN (1, 2)"),
            ("is_equal_to", "size_text", "size_text <> '7'"),
            ("is_equal_to", "flag", "flag <> 'true'"),
            ("is_in_list", "label", "label NOT IN ('it''s \\ ECONOMY', 'it''s \\ STANDARD')"),
        ],
    ),
}
