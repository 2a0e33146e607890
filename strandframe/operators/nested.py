"""Arrays, maps and structs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_array(df: DataFrame, array: str, keep: Sequence[str], position: str = "position", value: str = "value") -> DataFrame:
    """One row for each element, with its place from 0; null and empty arrays vanish."""
    return df.select(*keep, F.posexplode(array).alias(position, value))


def filter_flatten(array: Column, keep: Callable[[Column], Column], inner: Callable[[Column], Column]) -> Column:
    """The inner arrays of the elements that pass, joined; an absent array gives an empty one."""
    return F.coalesce(F.flatten(F.transform(F.filter(array, keep), inner)), F.array())


def get_or(default: object, *paths: Column) -> Column:
    """The first path with a value."""
    return F.coalesce(*paths, F.lit(default))


def pivot_matrix(df: DataFrame, row: str, column: str, value: Column, values: Sequence[str]) -> DataFrame:
    """One row for each `row`, a column for each of `values` in sorted order; absent cells are 0. The given list saves a pass."""
    order = sorted(values)
    out = df.groupBy(row).pivot(column, order).agg(value)
    return out.na.fill(0, order).select(row, *order)


def map_group_last(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """The value written last for each key."""
    return df.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"__{i}") for i, o in enumerate(order)], F.col(value))).alias("m")).select(*keys, F.col(f"m.{value}").alias(value))


def array_max_center(array: Column) -> Column:
    """Elements less the greatest of the array."""
    top = F.array_max(array)
    return F.transform(array, lambda x: x - top)
