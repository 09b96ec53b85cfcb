"""Set operations that keep duplicates where tables do, and null-safe membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame


def _same(x: DataFrame, y: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [x[c].eqNullSafe(y[c]) for c in x.columns])


def union(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.unionByName(y).distinct()


def union_all(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.unionByName(y)


def inter(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of x that y has, duplicates of x kept."""
    y = y.select(*x.columns).distinct()
    return x.join(y, _same(x, y), "left_semi")


def except_(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of x that y has not, duplicates of x kept."""
    y = y.select(*x.columns).distinct()
    return x.join(y, _same(x, y), "left_anti")


def distinct(x: DataFrame) -> DataFrame:
    return x.distinct()
