"""Check sets over a table: all checks of a contract in one projection or one aggregate."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.errors import ContractError
from tablepact.functions import checks as predicates
from tablepact.functions.casts import MOMENTS, cast_to
from tablepact.functions.columns import column
from tablepact.operators.apply import Staged, project, stage
from tablepact.plans.contract import Contract
from tablepact.plans.rules import IS_READABLE, SQL_EXPRESSION, UNREADABLE, Check

ERRORS = "_errors"

ERRORS_TYPE = "array<struct<check: string, column: string, message: string>>"

SUMMARY_SCHEMA = "check_no int, check string, column string, rows bigint, violations bigint, rate double"


def predicate(staged: Staged, check: Check) -> Column:
    """The rule's condition on the staged frame: TRUE, FALSE, or NULL for a missing value."""
    if check.rule == SQL_EXPRESSION:
        return predicates.sql_expression(*check.args)
    if check.rule == IS_READABLE:
        return column([UNREADABLE]).isNull()
    if check.rule in MOMENT_RULES and _arrives_as_moment(staged, check):
        return F.lit(True)
    builder = predicates.CHECKS.get(check.rule)
    if builder is None:
        raise ContractError(f"no check named {check.rule!r}")
    value = _operand(staged, check)
    arguments = check.args
    if check.rule in predicates.TYPED_ARGUMENT_RULES:
        arguments = (*arguments, check.data_type)
    condition = builder(value, *arguments)
    return condition if check.required else predicates.null_safe(value, condition)


def _operand(staged: Staged, check: Check) -> Column:
    if check.reads_text:
        found = staged.leaf(check.path)
        return cast_to(*found, T.StringType()) if found else F.lit(None).cast("string")
    value = staged.typed(check.path, check.data_type)
    if check.rule in NUMERIC_RULES and isinstance(check.data_type, T.StringType):
        return value.try_cast("double")
    return value


def _arrives_as_moment(staged: Staged, check: Check) -> bool:
    """Dates and timestamps that are typed already cannot be malformed."""
    found = staged.leaf(check.path)
    return found is not None and isinstance(found[1], MOMENTS)


MOMENT_RULES = frozenset({"is_valid_date", "is_valid_timestamp"})

# Numeric rules on a text column compare the number the text spells.
NUMERIC_RULES = frozenset(
    {
        "is_in_range",
        "is_not_less_than",
        "is_not_greater_than",
        "exclusive_minimum",
        "exclusive_maximum",
        "multiple_of",
    }
)


@dataclass(frozen=True)
class Checked:
    """A contract bound to a frame, with one failure condition per check.

    A failure condition is TRUE where the row breaks the rule and FALSE or NULL elsewhere.
    """

    contract: Contract
    staged: Staged
    failures: list[Column]

    @property
    def any_failure(self) -> Column:
        return _balanced_or(self.failures) if self.failures else F.lit(False)

    @property
    def failed(self) -> Column:
        """The failed checks of a row, in reporting order."""
        entries = error_entries(self.contract.checks)
        none = F.slice(entries, 1, 0)
        parts = [F.when(fails, F.slice(entries, n, 1)).otherwise(none) for n, fails in enumerate(self.failures, 1)]
        return F.concat(*parts) if parts else none

    @property
    def errors(self) -> Column:
        """As ``failed``, with the list built only for rows that need one: most are clean."""
        return F.when(self.any_failure, self.failed).otherwise(F.slice(error_entries(()), 1, 0))


def error_entries(checks: Sequence[Check]) -> Column:
    """What each check reports when it fails: one constant, which the optimizer takes apart."""
    entries = [{"check": c.rule, "column": c.column, "message": c.message} for c in checks]
    return F.from_json(F.lit(json.dumps(entries)), ERRORS_TYPE)


def bind(df: DataFrame, contract: Contract, whole: bool = False) -> Checked:
    """Bind the contract's checks; ``whole`` parses all nested columns, not just checked parts.

    Rows a reader could not read break a check of their own, which comes last.
    """
    if UNREADABLE in df.columns:
        contract = replace(contract, checks=(*contract.checks, Check(IS_READABLE, (), (), "the row must be readable")))
    staged = stage(df, contract, None if whole else [c.path for c in contract.checks if c.path])
    return Checked(contract, staged, [~predicate(staged, c) for c in contract.checks])


def _balanced_or(conditions: Sequence[Column]) -> Column:
    if len(conditions) == 1:
        return conditions[0]
    middle = len(conditions) // 2
    return _balanced_or(conditions[:middle]) | _balanced_or(conditions[middle:])


def own_columns(df: DataFrame) -> list[Column]:
    """The frame's columns without those this module adds."""
    return [column([c]) for c in df.columns if c != ERRORS]


def annotate(df: DataFrame, contract: Contract) -> DataFrame:
    """Add ``_errors``: an array of ``{check, column, message}``, one per failed check."""
    checked = bind(df, contract)
    return checked.staged.frame.select(*own_columns(df), checked.errors.alias(ERRORS))


def split(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and rows that break at least one with their ``_errors``.

    The quarantine side filters on the bare failure conditions, so the simple ones reach
    the file scan and row groups without offenders can be skipped.
    """
    checked = bind(df, contract)
    frame = checked.staged.frame
    valid = frame.where(~F.coalesce(checked.any_failure, F.lit(False))).select(*own_columns(df))
    quarantine = frame.where(checked.any_failure).select(*own_columns(df), checked.failed.alias(ERRORS))
    return valid, quarantine


def accepted(df: DataFrame, contract: Contract) -> DataFrame:
    """Valid rows in the declared columns and types."""
    checked = bind(df, contract, whole=True)
    passing = checked.staged.frame.where(~F.coalesce(checked.any_failure, F.lit(False)))
    return project(Staged(passing, checked.staged.roots), contract)


def violations(df: DataFrame, contract: Contract, key: str | Sequence[str]) -> DataFrame:
    """One row per failed check of each row, identified by its key columns."""
    checked = bind(df, contract)
    keys = [column([k]) for k in ([key] if isinstance(key, str) else key)]
    return (
        checked.staged.frame.where(checked.any_failure)
        .select(*keys, checked.failed.alias(ERRORS))
        .select(*keys, F.inline(ERRORS))
    )


def summarise(df: DataFrame, contract: Contract) -> DataFrame:
    """Per check, in reporting order: rows seen, violations and their rate, in one scan.

    A single partial/final aggregate counts every check at once: each task sends one row,
    and only the columns named by checks are read.
    """
    checked = bind(df, contract)
    if not checked.failures:
        return df.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
    counts = checked.staged.frame.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(fails, 1)).alias(f"v{n}") for n, fails in enumerate(checked.failures)],
    )
    named = [{"check_no": n, "check": c.rule, "column": c.column} for n, c in enumerate(checked.contract.checks, 1)]
    names = F.from_json(F.lit(json.dumps(named)), "array<struct<check_no: int, check: string, column: string>>")
    numbers = F.array(*[f"v{n}" for n in range(len(named))])
    return counts.select("rows", F.inline(F.arrays_zip(names.alias("name"), numbers.alias("violations")))).select(
        "name.*", "rows", "violations", F.try_divide("violations", "rows").alias("rate")
    )
