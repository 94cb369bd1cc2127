"""Every check on a passing, a failing, a missing and an edge value."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact import Contract, ContractError, annotate, register_check, summarise
from tablepact.functions.checks import CHECKS

CASES = [
    # rule, field, Spark type, values that pass, values that fail
    ("is_in_list", {"type": "string", "enum": ["a", "b"]}, "string", ["a", "b"], ["c", "", "A"]),
    ("is_in_list", {"type": "string", "enum": [None]}, "string", [], ["a"]),
    ("is_in_list", {"type": "integer", "enum": [1, 2]}, "bigint", [1, 2], [3, 0]),
    ("is_in_list", {"type": "integer", "enum": ["1"]}, "bigint", [], [1]),
    ("is_in_list", {"format": "date", "enum": ["2024-01-01"]}, "string", ["2024-01-01"], ["2024-01-02"]),
    ("is_equal_to", {"type": "string", "const": "1"}, "string", ["1"], ["01", "1.0"]),
    ("is_equal_to", {"type": "string", "const": "true"}, "string", ["true"], ["True", "1"]),
    ("is_equal_to", {"type": "string", "const": "it's \\ here"}, "string", ["it's \\ here"], ["its  here"]),
    ("is_equal_to", {"type": "number", "const": 1}, "double", [1.0], [1.5]),
    ("is_equal_to", {"type": "boolean", "const": False}, "boolean", [False], [True]),
    ("is_in_range", {"type": "number", "minimum": 1, "maximum": 2}, "double", [1.0, 2.0], [0.99, 2.01, float("nan")]),
    ("is_in_range", {"type": "string", "minimum": 1, "maximum": 2}, "string", ["1", "2", "word"], ["3"]),
    ("is_not_less_than", {"type": "integer", "minimum": 0.5}, "int", [1], [0, -1]),
    ("is_not_greater_than", {"type": "integer", "maximum": 10**30}, "bigint", [2**62], []),
    ("exclusive_minimum", {"type": "number", "exclusiveMinimum": 0}, "double", [0.1], [0.0, -0.0, -1.0]),
    ("exclusive_maximum", {"type": "integer", "exclusiveMaximum": 5}, "bigint", [4], [5, 6]),
    ("min_length", {"type": "string", "minLength": 2}, "string", ["ab", "éé"], ["a", "", "é"]),
    ("max_length", {"type": "string", "maxLength": 2}, "string", ["", "éé"], ["abc"]),
    ("max_length", {"type": "integer", "maxLength": 2}, "bigint", [12], [123]),
    ("regex_match", {"type": "string", "pattern": "b+"}, "string", ["abc", "b"], ["ac", ""]),
    ("multiple_of", {"type": "integer", "multipleOf": 5}, "bigint", [0, 5, -10], [3]),
    ("multiple_of", {"type": "number", "multipleOf": 0.5}, "double", [1.5, 0.0], [0.7]),
    ("min_items", {"type": "array", "minItems": 1}, "array<string>", [["a"]], [[]]),
    ("max_items", {"type": "array", "maxItems": 1}, "array<string>", [[], ["a"]], [["a", "b"]]),
    ("is_valid_date", {"format": "date"}, "string", ["2024-02-29", "2024-01"], ["2023-02-29", "soon", ""]),
    ("is_valid_date", {"format": "date"}, "date", [dt.date(2024, 1, 1)], []),
    ("is_valid_timestamp", {"format": "date-time"}, "string", ["2024-01-01T10:00:00Z", "2024-01-01"], ["noon", "2024-13-01T00:00:00Z"]),
    ("is_valid_ipv4_address", {"format": "ipv4"}, "string", ["0.0.0.0", "255.255.255.255"], ["256.1.1.1", "1.2.3", "a 1.2.3.4"]),
    ("is_valid_ipv6_address", {"format": "ipv6"}, "string", ["::", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8"], ["1:2", ":::", "g::1", "1:2:3:4:5:6:7:8:9"]),
    ("is_uuid", {"format": "uuid"}, "string", ["00000000-0000-4000-8000-00000000000A"], ["00000000-0000-4000-8000-00000000000", "x"]),
    ("is_email", {"format": "email"}, "string", ["a.b+c@x-y.org"], ["a@b", "@x.org", "a b@x.org"]),
]


@pytest.mark.parametrize("rule, prop, spark_type, passing, failing", CASES)
@pytest.mark.parametrize("required", [False, True])
def test_check(spark, rule, prop, spark_type, passing, failing, required):
    contract = Contract.from_schema({"properties": {"v": prop}, "required": ["v"] if required else []})
    values = [(n, v) for n, v in enumerate([*passing, *failing, None])]
    df = spark.createDataFrame(values, f"n int, v {spark_type}")
    found = {r.n: [e.check for e in r._errors] for r in annotate(df, contract).collect()}
    for n in range(len(passing)):
        assert rule not in found[n], values[n]
    for n in range(len(passing), len(passing) + len(failing)):
        assert rule in found[n], values[n]
    assert found[len(values) - 1] == (["is_not_null"] if required else [])


def test_unreadable_value_of_a_required_column_is_a_missing_one(spark):
    contract = Contract.from_schema(
        {"required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "m": {"type": "integer", "minimum": 1}}}
    )
    df = spark.createDataFrame([("x", "x")], "n string, m string")
    assert [e.check for e in annotate(df, contract).first()._errors] == ["is_not_null"]


def test_text_rules_read_the_text_and_the_rest_the_typed_value(spark):
    contract = Contract.from_schema({"properties": {"n": {"type": "integer", "pattern": "^0", "maximum": 9}}})
    df = spark.createDataFrame([("007",), ("7",), ("011",)], "n string")
    found = [[e.check for e in r._errors] for r in annotate(df, contract).collect()]
    assert found == [[], ["regex_match"], ["is_not_greater_than"]]


def test_missing_parent_breaks_a_required_child_only(spark):
    contract = Contract.from_schema(
        {
            "required": ["a"],
            "properties": {
                "a": {
                    "type": "object",
                    "required": ["b"],
                    "properties": {"b": {"type": "string"}, "c": {"type": "string", "minLength": 2}},
                }
            },
        }
    )
    df = spark.createDataFrame([(None,), (("x", None),), (("x", "y"),)], "a struct<b: string, c: string>")
    found = [[(e.check, e.column) for e in r._errors] for r in annotate(df, contract).collect()]
    assert found == [[("is_not_null", "a.b")], [], [("min_length", "a.c")]]


def test_names_with_dots_and_backticks(spark):
    contract = Contract.from_schema(
        {"properties": {"a.b": {"minLength": 2}, "c`d": {"type": "object", "properties": {"e.f": {"maxLength": 1}}}}}
    )
    df = spark.createDataFrame(
        [("x", ("yy",))],
        T.StructType(
            [
                T.StructField("a.b", T.StringType()),
                T.StructField("c`d", T.StructType([T.StructField("e.f", T.StringType())])),
            ]
        ),
    )
    assert [e.column for e in annotate(df, contract).first()._errors] == ["a.b", "c`d.e.f"]


def test_sql_expression(spark):
    contract = Contract.from_schema({"properties": {}}).with_expression("a < b", "a must be below b")
    df = spark.createDataFrame([(1, 2), (2, 1), (None, 1)], "a int, b int")
    found = [[(e.check, e.message) for e in r._errors] for r in annotate(df, contract).collect()]
    assert found == [[], [("sql_expression", "a must be below b")], []]


def test_further_rules_can_be_registered(spark):
    register_check("starts_with_test", lambda value, prefix: value.startswith(prefix))
    try:
        df = spark.createDataFrame([("ab",), ("ba",)], "s string")
        assert [r[0] for r in df.select(CHECKS["starts_with_test"](F.col("s"), "a")).collect()] == [True, False]
        contract = Contract.from_schema({"properties": {"s": {"type": "string"}}}).with_check("starts_with_test", "s", "a")
        assert [r.violations for r in summarise(df, contract).collect()] == [1]
        with pytest.raises(ContractError, match="no field"):
            contract.with_check("starts_with_test", "t", "a")
        with pytest.raises(ValueError):
            register_check("is_uuid", lambda value: value)
    finally:
        del CHECKS["starts_with_test"]
    with pytest.raises(ContractError, match="starts_with_test"):
        summarise(df, contract)


def test_bad_values_do_not_end_the_job_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    contract = Contract.from_schema(
        {
            "properties": {
                "d": {"format": "date"},
                "t": {"format": "date-time"},
                "n": {"type": "integer", "multipleOf": 3, "enum": [3, "x"]},
            }
        }
    )
    df = spark.createDataFrame([("?", "?", "?")], "d string, t string, n string")
    assert [r.violations for r in summarise(df, contract).collect()] == [1, 1, 0, 0]


@pytest.mark.parametrize(
    ("rule", "broken"),
    [
        ({"enum": ["2024-01-01", "20240303", "2024-W05-1"]}, ["2024-02-02"]),
        ({"const": "20240101"}, ["2024-01-01", "2024-02-02"]),
        ({"enum": ["2024-01", "2024-02-02"]}, []),
    ],
)
def test_date_members_are_read_as_spark_reads_dates(spark, rule, broken):
    contract = Contract.from_schema({"properties": {"d": {"type": "string", "format": "date", **rule}}})
    rows = spark.createDataFrame([("2024-01-01",), ("2024-02-02",), (None,)], "d string")
    assert [r.d for r in annotate(rows, contract).where("size(_errors) > 0").collect()] == broken


@pytest.mark.parametrize("rule", [{"enum": [["a"]]}, {"const": ["a"]}])
def test_members_of_arrays_are_refused(rule):
    with pytest.raises(ContractError, match="does not apply to an array"):
        Contract.from_schema({"properties": {"a": {"type": "array", "items": {"type": "string"}, **rule}}})
