"""Sorting, taking, dropping, top-k and binary search over declared orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolumna.operators.joins import asof_rows
from kolumna.qtable import ROW, QTable, numbered, positions


def xasc(t: QTable, *cols: str) -> DataFrame:
    """Ascending, nulls first, ties in row order."""
    return t.df.orderBy(*[F.col(c).asc_nulls_first() for c in (*cols, *t.order)])


def xdesc(t: QTable, *cols: str) -> DataFrame:
    """Descending, nulls last, ties in row order."""
    return t.df.orderBy(*[F.col(c).desc_nulls_last() for c in cols], *t.ordered())


def topk(df: DataFrame, k: int, sort: Sequence[Column]) -> DataFrame:
    return df.orderBy(*sort).limit(k)


def iasc(t: QTable, col: str) -> DataFrame:
    """Row numbers in ascending order of a column: (position, row)."""
    rows = numbered(t).select(col, ROW)
    return numbered(QTable(rows, order=(col, ROW)), "position").select("position", F.col(ROW).alias("row"))


def idesc(t: QTable, col: str) -> DataFrame:
    """Row numbers in descending order of a column, ties in row order: (position, row)."""
    rows = numbered(t).select(F.col(col).alias("__v"), ROW)
    order = rows.orderBy(F.col("__v").desc_nulls_last(), ROW)
    return positions(order, "position").select("position", F.col(ROW).alias("row"))


def take(t: QTable, n: int) -> DataFrame:
    """The first n rows, or the last -n; more than there are repeat them from the start."""
    size = t.df.count()
    if n < 0:
        return t.df.orderBy(*[F.col(c).desc_nulls_last() for c in t.order]).limit(-n)
    if n <= size or not size:
        return t.df.orderBy(*t.ordered()).limit(n)
    rows = numbered(t)
    repeats = F.sequence(F.lit(0), F.floor((F.lit(n - 1) - F.col(ROW)) / size).cast("int"))
    return rows.withColumn("__again", F.explode(repeats)).drop(ROW, "__again")


def drop(t: QTable, n: int) -> DataFrame:
    """Without the first n rows, or the last -n."""
    rows = numbered(t)
    return rows.where(F.col(ROW) >= n).drop(ROW) if n >= 0 else rows.where(F.col(ROW) < t.df.count() + n).drop(ROW)


def sublist(t: QTable, start: int, length: int) -> DataFrame:
    rows = numbered(t)
    return rows.where((F.col(ROW) >= start) & (F.col(ROW) < start + length)).drop(ROW)


def cut(t: QTable, n: int) -> DataFrame:
    """Rows with the number of their chunk of n."""
    return numbered(t).withColumn("chunk", F.floor(F.col(ROW) / n)).drop(ROW)


def rotate(t: QTable, n: int) -> DataFrame:
    """Rows with their position after rotating n to the left."""
    size = t.df.count()
    return numbered(t).withColumn("position", F.pmod(F.col(ROW) - n, F.lit(size))).drop(ROW)


def reverse(t: QTable) -> DataFrame:
    return t.df.orderBy(*[F.col(c).desc_nulls_last() for c in t.order])


def bin_(sorted_: QTable, values: DataFrame, key: str) -> DataFrame:
    """For each value, the row number of the last item not above it (-1: none)."""
    items = QTable(numbered(sorted_).select(F.col(sorted_.order[0]).alias(key), F.col(ROW).alias("__at")), order=("__at",))
    found, _ = asof_rows(QTable(values), items, [key])
    return found.select(*values.columns, F.coalesce(F.col("__m.__at"), F.lit(-1)).alias("bin"))
