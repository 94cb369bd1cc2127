"""Row checks as Catalyst predicates.

Each builder takes the column to test and the rule's arguments and returns a boolean
column. A row breaks a rule only when the predicate is FALSE: NULL input gives NULL,
which is no violation, so a missing value is reported by the not-null rule alone.

``CHECKS`` maps rule name to builder; :func:`register_check` adds to it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns of the text formats. Octets are 0 to 255; IPv6 is the full
# form and every "::"-compressed one; a UUID is 8-4-4-4-12 hex digits.
IPV4_PATTERN = r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
IPV6_PATTERN = r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:((:[0-9a-fA-F]{1,4}){1,6})|:((:[0-9a-fA-F]{1,4}){1,7}|:))$"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"


def is_not_null(value: Column) -> Column:
    return value.isNotNull()


def is_in_list(value: Column, allowed: tuple, data_type: T.DataType | None = None) -> Column:
    members = [typed_literal(v, data_type) for v in allowed]
    if not members:
        # Nothing is allowed: every present value breaks the rule.
        return F.when(value.isNotNull(), F.lit(False))
    if isinstance(data_type, (T.DateType, T.TimestampType)):
        # A member that is no date is NULL, and no value equals it: it must not make the answer NULL.
        return F.array_contains(F.filter(F.array(*members), lambda member: member.isNotNull()), value)
    return value.isin(*members)


def is_in_range(value: Column, low, high) -> Column:
    return value.between(F.lit(low), F.lit(high))


def is_not_less_than(value: Column, low) -> Column:
    return value >= F.lit(low)


def is_not_greater_than(value: Column, high) -> Column:
    return value <= F.lit(high)


def exclusive_minimum(value: Column, bound) -> Column:
    return value > F.lit(bound)


def exclusive_maximum(value: Column, bound) -> Column:
    return value < F.lit(bound)


def min_length(value: Column, n: int) -> Column:
    return F.length(value) >= F.lit(n)


def max_length(value: Column, n: int) -> Column:
    return F.length(value) <= F.lit(n)


def regex_match(value: Column, pattern: str) -> Column:
    return value.rlike(pattern)


def multiple_of(value: Column, n) -> Column:
    return F.try_mod(value, F.lit(n)) == F.lit(0)


def min_items(value: Column, n: int) -> Column:
    return _item_count(value) >= F.lit(n)


def max_items(value: Column, n: int) -> Column:
    return _item_count(value) <= F.lit(n)


def _item_count(value: Column) -> Column:
    # Independent of the session's choice for the size of NULL.
    return F.when(value.isNotNull(), F.size(value))


def is_valid_date(value: Column) -> Column:
    return F.when(value.isNotNull(), F.try_to_date(value).isNotNull())


def is_valid_timestamp(value: Column) -> Column:
    return F.when(value.isNotNull(), F.try_to_timestamp(value).isNotNull())


def null_safe(value: Column, predicate: Column) -> Column:
    """The rule of an optional column: a missing value passes."""
    return value.isNull() | predicate


def sql_expression(expression: str) -> Column:
    return F.expr(expression)


def typed_literal(value, data_type: T.DataType | None) -> Column:
    """A literal of the column's own type; never spliced into SQL text."""
    literal = F.lit(value)
    if isinstance(data_type, T.DateType):
        return F.try_to_date(literal)
    if isinstance(data_type, T.TimestampType):
        return F.try_to_timestamp(literal)
    return literal


CHECKS: dict[str, Callable[..., Column]] = {
    "is_not_null": is_not_null,
    "is_in_list": is_in_list,
    "is_equal_to": is_in_list,
    "is_in_range": is_in_range,
    "is_not_less_than": is_not_less_than,
    "is_not_greater_than": is_not_greater_than,
    "exclusive_minimum": exclusive_minimum,
    "exclusive_maximum": exclusive_maximum,
    "min_length": min_length,
    "max_length": max_length,
    "regex_match": regex_match,
    "multiple_of": multiple_of,
    "min_items": min_items,
    "max_items": max_items,
    "is_valid_date": is_valid_date,
    "is_valid_timestamp": is_valid_timestamp,
    "is_valid_ipv4_address": partial(regex_match, pattern=IPV4_PATTERN),
    "is_valid_ipv6_address": partial(regex_match, pattern=IPV6_PATTERN),
    "is_uuid": partial(regex_match, pattern=UUID_PATTERN),
    "is_email": partial(regex_match, pattern=EMAIL_PATTERN),
}

# Rules whose arguments are compared with the value and so need its declared type.
TYPED_ARGUMENT_RULES = frozenset({"is_in_list", "is_equal_to"})


def register_check(name: str, builder: Callable[..., Column]) -> None:
    """Make a further rule available by name; a name is taken once."""
    if name in CHECKS:
        raise ValueError(f"check {name!r} already exists")
    CHECKS[name] = builder
