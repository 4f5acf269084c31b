"""Rule lists: every rule is (message, condition that holds for a bad row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Rule = tuple[str, Column]


def violations(rules: Sequence[Rule]) -> Column:
    """Array of the messages of broken rules, in rule order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for message, bad in rules]))


def with_errors(df: DataFrame, rules: Sequence[Rule], column: str = "errors") -> DataFrame:
    return df.withColumn(column, violations(rules))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with their ``errors``)."""
    checked = with_errors(df, rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def length_outside(column: Column, low: int, high: int) -> Column:
    """Length outside [low, high]; blank text is left to the required rule."""
    return ~blank(column) & ~F.length(column).between(low, high)


def not_in(column: Column, allowed: Sequence[str]) -> Column:
    """A value that is present but not allowed."""
    return ~blank(column) & ~column.isin(*allowed)


def not_iso(column: Column) -> Column:
    """Text that is present but no ISO date or date-time."""
    return ~blank(column) & column.try_cast("timestamp_ntz").isNull()
