"""From constraint keywords to an ordered list of checks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from tablepact.errors import ContractError

# The constraint keywords a field may carry, in documentation order.
CONSTRAINT_KEYWORDS = (
    "enum",
    "const",
    "pattern",
    "format",
    "minLength",
    "maxLength",
    "minimum",
    "maximum",
    "exclusiveMinimum",
    "exclusiveMaximum",
    "multipleOf",
    "minItems",
    "maxItems",
)

# Format keyword to check.
CHECK_BY_FORMAT = {
    "date": "is_valid_date",
    "date-time": "is_valid_timestamp",
    "ipv4": "is_valid_ipv4_address",
    "ipv6": "is_valid_ipv6_address",
    "uuid": "is_uuid",
    "email": "is_email",
}

# Rules about how a value is written read the raw text, before any cast;
# the rest read the typed value.
TEXT_RULES = frozenset({*CHECK_BY_FORMAT.values(), "min_length", "max_length", "regex_match"})

SQL_EXPRESSION = "sql_expression"

# The column in which readers keep what they could not read, and the rule that it is empty.
UNREADABLE, IS_READABLE = "_unreadable", "is_readable"

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Check:
    """One rule on one path. A row breaks it when the rule's predicate is false."""

    rule: str
    path: tuple[str, ...]
    args: tuple[Any, ...] = ()
    message: str = ""
    required: bool = False
    data_type: T.DataType | None = None

    @property
    def column(self) -> str:
        return ".".join(self.path)

    @property
    def reads_text(self) -> bool:
        return self.rule in TEXT_RULES


def sql_check(expression: str, message: str = "") -> Check:
    return Check(SQL_EXPRESSION, (), (expression,), message or f"{expression} must hold")


# What a row that breaks the rule is told; {0} and {1} are the rule's arguments.
MESSAGES = {
    "is_not_null": "{column} must not be null",
    "is_valid_date": "{column} must be a valid date",
    "is_valid_timestamp": "{column} must be a valid timestamp",
    "is_valid_ipv4_address": "{column} must be a valid IPv4 address",
    "is_valid_ipv6_address": "{column} must be a valid IPv6 address",
    "is_uuid": "{column} must be a valid UUID",
    "is_email": "{column} must be a valid email address",
    "is_in_list": "{column} must be in the allowed values",
    "is_equal_to": "{column} must equal {0}",
    "is_in_range": "{column} must be between {0} and {1}",
    "is_not_less_than": "{column} must not be less than {0}",
    "is_not_greater_than": "{column} must not be greater than {0}",
    "exclusive_minimum": "{column} must be greater than {0}",
    "exclusive_maximum": "{column} must be less than {0}",
    "min_length": "{column} must have minimum length of {0}",
    "max_length": "{column} must have maximum length of {0}",
    "regex_match": "{column} must match pattern {0}",
    "multiple_of": "{column} must be a multiple of {0}",
    "min_items": "{column} must have at least {0} items",
    "max_items": "{column} must have at most {0} items",
}

# Keywords with a whole-number limit, and their rules.
LENGTH_RULES = {"minLength": "min_length", "maxLength": "max_length"}
ITEM_RULES = {"minItems": "min_items", "maxItems": "max_items"}
EXCLUSIVE_RULES = {"exclusiveMinimum": "exclusive_minimum", "exclusiveMaximum": "exclusive_maximum"}


def checks_for(
    path: tuple[str, ...], data_type: T.DataType, required: bool, constraints: Mapping[str, Any]
) -> list[Check]:
    """Checks of one leaf, in reporting order."""
    column = ".".join(path)
    given = {keyword: value for keyword, value in constraints.items() if value is not None}
    rules = list(_array_rules(column, given) if isinstance(data_type, T.ArrayType) else _rules(column, given, data_type))
    if required:
        rules.insert(0, ("is_not_null", (), ()))
    return [
        Check(rule, path, args, MESSAGES[rule].format(*map(show, shown), column=column), required, data_type)
        for rule, args, shown in rules
    ]


# A rule to add: its name, its arguments, and the arguments as its message shows them.
Rule = tuple[str, tuple, tuple]


def _array_rules(column: str, given: Mapping[str, Any]) -> Iterator[Rule]:
    for keyword in ("enum", "const"):
        if keyword in given:
            raise ContractError(f"{column}: {keyword} does not apply to an array")
    for keyword, rule in ITEM_RULES.items():
        if keyword in given:
            yield _limit(rule, whole(column, keyword, given[keyword]))


def _rules(column: str, given: Mapping[str, Any], data_type: T.DataType) -> Iterator[Rule]:
    for keyword, kind in (("enum", list), ("pattern", str), ("format", str)):
        if not isinstance(given.get(keyword, kind()), kind):
            raise ContractError(f"{column}: {keyword} cannot be {given[keyword]!r}")
    if ITEM_RULES.keys() & given.keys():
        raise ContractError(f"{column}: minItems and maxItems need an array")
    if given.get("format") in CHECK_BY_FORMAT:
        yield CHECK_BY_FORMAT[given["format"]], (), ()
    if given.get("enum"):
        yield "is_in_list", (literals(given["enum"], data_type),), ()
    if "const" in given:
        yield "is_equal_to", (literals([given["const"]], data_type),), (given["const"],)
    yield from _bounds(column, given, data_type)
    for keyword, rule in LENGTH_RULES.items():
        if keyword in given:
            yield _limit(rule, whole(column, keyword, given[keyword]))
    if given.get("pattern"):
        yield _limit("regex_match", given["pattern"])
    if "multipleOf" in given:
        n = bound(column, "multipleOf", given["multipleOf"], data_type)
        if n <= 0:
            raise ContractError(f"{column}: multipleOf must be positive, not {n}")
        yield _limit("multiple_of", n)


def _bounds(column: str, given: Mapping[str, Any], data_type: T.DataType) -> Iterator[Rule]:
    ends = [bound(column, k, given[k], data_type) if k in given else None for k in ("minimum", "maximum")]
    if None not in ends:
        yield "is_in_range", tuple(ends), tuple(ends)
    elif ends[0] is not None:
        yield _limit("is_not_less_than", ends[0])
    elif ends[1] is not None:
        yield _limit("is_not_greater_than", ends[1])
    for keyword, rule in EXCLUSIVE_RULES.items():
        if keyword in given:
            yield _limit(rule, bound(column, keyword, given[keyword], data_type))


def _limit(rule: str, value: Any) -> Rule:
    return rule, (value,), (value,)


def bound(column: str, keyword: str, value: Any, data_type: T.DataType) -> int | float:
    """A numeric limit on a field that can be compared with numbers."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.BooleanType)):
        raise ContractError(f"{column}: {keyword} does not apply to {data_type.simpleString()}")
    return number(column, keyword, value)


def number(column: str, keyword: str, value: Any) -> int | float:
    """A numeric bound; whole floats become integers when a bigint can hold them."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ContractError(f"{column}: {keyword} must be a number, not {value!r}")
    if isinstance(value, float) and value.is_integer() and LONG_MIN <= value <= LONG_MAX:
        value = int(value)
    if isinstance(value, int) and not LONG_MIN <= value <= LONG_MAX:
        return float(value)
    return value


def whole(column: str, keyword: str, value: Any) -> int:
    n = number(column, keyword, value)
    if not isinstance(n, int) or n < 0:
        raise ContractError(f"{column}: {keyword} must be a whole number, not {value!r}")
    return n


def literals(values: list[Any], data_type: T.DataType) -> tuple[Any, ...]:
    """The members a column of this type can hold, each of that type.

    Nulls are dropped (a missing value is the not-null check's business), and so are
    members of another type: they could match no value of the column.
    """
    kept = [literal(v, data_type) for v in values if v is not None]
    return tuple(v for v in kept if v is not None)


def literal(value: Any, data_type: T.DataType) -> Any:
    if isinstance(data_type, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(data_type, (T.LongType, T.DoubleType)):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return None
        if isinstance(data_type, T.DoubleType):
            return float(value)
        return int(value) if float(value).is_integer() and LONG_MIN <= value <= LONG_MAX else None
    if not isinstance(value, str):
        return None
    return value  # dates and timestamps stay text here: Spark reads them, as it reads the column


def show(value: Any) -> str:
    """A value as it reads in messages: whole floats without a fraction, JSON booleans."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)
