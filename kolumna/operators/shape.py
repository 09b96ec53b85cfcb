"""Shaping: enkeying, filling in columns, keyed coalesce, column dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.operators.joins import ujf
from kolumna.qtable import QTable


def add_missing(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with null columns for those that only ``like`` has."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in like.dtypes if c not in df.columns})


def on_distinct(df: DataFrame, column: str, f: Callable, name: str) -> DataFrame:
    """f of a column, computed once per distinct value and joined back."""
    return df.join(df.select(column).distinct().withColumn(name, f(F.col(column))), column)


def coalesce(x: QTable, y: QTable) -> QTable:
    """Keyed merge in which nulls do not overwrite."""
    return ujf(x, y)


def flip(df: DataFrame, index: str) -> DataFrame:
    """Columns as rows: (index value, column, value as text)."""
    rest = [c for c in df.columns if c != index]
    return df.select(index, *[F.col(c).cast("string").alias(c) for c in rest]).unpivot([index], rest, "column", "value")
