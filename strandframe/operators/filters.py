"""Filters and projections. Conditions are plain expressions, so Parquet scans take them over where they can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold(df: DataFrame, column: str, limit: float, inclusive: bool) -> DataFrame:
    return df.where(F.col(column) <= limit if inclusive else F.col(column) < limit)


def conjunctive(df: DataFrame, equal: Mapping[str, object], at_most: Mapping[str, float], present: Sequence[str]) -> DataFrame:
    """Rows that meet all conditions: equalities, inclusive upper bounds, and columns that are not null."""
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    for column, value in at_most.items():
        df = df.where(F.col(column) <= value)
    for column in present:
        df = df.where(F.col(column).isNotNull())
    return df


def not_in(df: DataFrame, column: str, excluded: Sequence[object]) -> DataFrame:
    """Rows whose value is not listed; null is not listed."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*excluded)) if excluded else df


def starts_with(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def within(df: DataFrame, start: str, end: str, low, high) -> DataFrame:
    """Rows whose range lies wholly inside low to high."""
    return df.where((F.col(start) >= low) & (F.col(end) <= high))


def route(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the condition, all others, null included)."""
    met = F.coalesce(condition, F.lit(False))
    return df.where(met), df.where(~met)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def first_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The n first rows of a total order."""
    return df.orderBy(*order).limit(n)
