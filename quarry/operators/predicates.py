"""Predicate algebra: small values that become Columns. A missing value makes every test false but the negated ones."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import ascii_fold


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def eq(field: str, value: Any) -> Column:
    """Strings compare without regard to ASCII case, numbers as doubles."""
    if isinstance(value, str):
        return _false(ascii_fold(field) == ascii_fold(F.lit(value)))
    if isinstance(value, bool):
        return _false(F.col(field) == value)
    return _false(F.col(field).try_cast("double") == float(value))


def ne(field: str, value: Any) -> Column:
    return F.col(field).isNotNull() & ~eq(field, value)


def gt(field: str, value: Any) -> Column:
    return _false(_ordered(field, value) > F.lit(value))


def lt(field: str, value: Any) -> Column:
    return _false(_ordered(field, value) < F.lit(value))


def ge(field: str, value: Any) -> Column:
    """More or equal, where equality is that of eq()."""
    return gt(field, value) | eq(field, value)


def le(field: str, value: Any) -> Column:
    return lt(field, value) | eq(field, value)


def _ordered(field: str, value: Any) -> Column:
    return F.col(field) if isinstance(value, str) else F.col(field).try_cast("double")


def is_in(field: str, values: list) -> Column:
    return reduce(lambda a, b: a | b, [eq(field, v) for v in values], F.lit(False))


def not_in(field: str, values: list) -> Column:
    """True for a missing value."""
    return ~is_in(field, values)


def like(field: str, pattern: str) -> Column:
    return _false(F.col(field).like(pattern))


def not_like(field: str, pattern: str) -> Column:
    """True for a missing value."""
    return ~like(field, pattern)


def contains(field: str, text: str) -> Column:
    return _false(F.col(field).contains(text))


def starts_with(field: str, text: str) -> Column:
    return _false(F.col(field).startswith(text))


def ends_with(field: str, text: str) -> Column:
    return _false(F.col(field).endswith(text))


def matches(field: str, pattern: str) -> Column:
    return _false(F.col(field).rlike(pattern))


def overlaps(field: str, values: list) -> Column:
    """Membership for an array field: any value in common."""
    return _false(F.arrays_overlap(F.col(field), F.array(*[F.lit(v) for v in values])))


def exists(field: str) -> Column:
    return F.col(field).isNotNull()


def not_exists(field: str) -> Column:
    return F.col(field).isNull()


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def negate(test: Column) -> Column:
    return ~_false(test)


class Query:
    """filter(), order_by(), limit() and offset() over a DataFrame; filters add up."""

    def __init__(self, df: DataFrame):
        self._df, self._order, self._limit, self._offset, self._fields = df, [], None, 0, []

    def filter(self, *tests: Column) -> Query:
        self._df = self._df.where(all_of(*tests))
        return self

    def order_by(self, field: str, descending: bool = False) -> Query:
        """Missing values come first, or last when descending."""
        self._order.append(F.col(field).desc_nulls_last() if descending else F.col(field).asc_nulls_first())
        return self

    def offset(self, n: int) -> Query:
        self._offset = n
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def select(self, *fields: str) -> Query:
        """Fields that don't exist come out as nulls."""
        self._fields = list(fields)
        return self

    def run(self) -> DataFrame:
        """Filter, sort, offset, limit, project; a sort may use a field that isn't selected."""
        df = self._df.orderBy(*self._order) if self._order else self._df
        df = df.offset(self._offset) if self._offset else df
        df = df if self._limit is None else df.limit(self._limit)
        return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in self._fields]) if self._fields else df
