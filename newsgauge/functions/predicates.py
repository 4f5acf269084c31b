"""Predicate algebra: typed ``Column`` conditions that Catalyst can push into the scan.

Three-valued SQL logic applies: a condition on NULL is neither true nor false, and ``negate`` keeps it so.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

_COMPARE = {
    "=": lambda c, v: c == v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
}


def ntz(value: datetime | str) -> Column:
    """A literal timestamp without zone."""
    return F.lit(str(value)).cast("timestamp_ntz")


def compare(column: str, op: str, value) -> Column:
    """``column <op> value`` for = >= <= > <; any other operator is an error, never a silent pass."""
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return _COMPARE[op](F.col(column), value if isinstance(value, Column) else F.lit(value))


def ticker_is(ticker: str) -> Column:
    return F.col("ticker") == ticker


def source_is(source: str) -> Column:
    return F.col("source") == source


def score_between(low: float, high: float, column: str = "sentiment_score") -> Column:
    """Inclusive at both ends."""
    return F.col(column).between(low, high)


def time_between(start, end, column: str = "ts") -> Column:
    """Inclusive at both ends."""
    return F.col(column).between(ntz(start), ntz(end))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def negate(condition: Column) -> Column:
    return ~condition


def text_has(column: str | Column, term: str) -> Column:
    """Case-insensitive substring."""
    column = F.col(column) if isinstance(column, str) else column
    return F.contains(F.lower(column), F.lit(term.lower()))


def equals_ci(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.lower()


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def has_all(column: str | Column, values: Sequence[str], ignore_case: bool = False) -> Column:
    """The array holds every one of ``values``."""
    column = F.col(column) if isinstance(column, str) else column
    if ignore_case:
        column = F.transform(column, lambda x: F.lower(x))
        values = [v.lower() for v in values]
    return F.size(F.array_except(string_array(values), column)) == 0


def has_any(column: str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col(column), string_array(values))
