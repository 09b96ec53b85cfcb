"""A DataFrame with two facts that DataFrames lack: which columns are keys, and which columns give the row order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kolumna.session import cut

ROW = "__row"


@dataclass(frozen=True)
class QTable:
    """df with key columns (possibly none) and the columns whose order is the row order.

    Parquet keeps no order, so verbs that depend on it (first, last, running sums, as-of ties) need ``order``; without
    one they raise instead of guessing.
    """

    df: DataFrame
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    def ordered(self) -> list:
        if not self.order:
            raise ValueError("this verb depends on row order: declare order=(columns...)")
        return [F.col(c).asc_nulls_first() for c in self.order]

    def with_(self, df: DataFrame, keys: Sequence[str] | None = None) -> QTable:
        kept = tuple(c for c in self.order if c in df.columns)
        return QTable(df, self.keys if keys is None else tuple(keys), kept if len(kept) == len(self.order) else ())

    def xkey(self, *keys: str) -> QTable:
        """Key by these columns, which come first."""
        missing = [k for k in keys if k not in self.df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        rest = [c for c in self.df.columns if c not in keys]
        return QTable(self.df.select(*keys, *rest), tuple(keys), self.order)

    def unkey(self) -> QTable:
        return QTable(self.df, (), self.order)

    def xcol(self, names: Sequence[str] | dict[str, str]) -> QTable:
        """Rename the first columns, or by a mapping."""
        to = names if isinstance(names, dict) else dict(zip(self.df.columns, names))
        if len({to.get(c, c) for c in self.df.columns}) < len(self.df.columns):
            raise ValueError("duplicate column names")
        swap = lambda cs: tuple(to.get(c, c) for c in cs)
        return QTable(self.df.withColumnsRenamed(to), swap(self.keys), swap(self.order))

    def xcols(self, *first: str) -> QTable:
        return QTable(self.df.select(*first, *[c for c in self.df.columns if c not in first]), self.keys, self.order)

    def meta(self) -> DataFrame:
        """Columns, types and key flags as a table."""
        rows = [(c, t, c in self.keys) for c, t in self.df.dtypes]
        return self.df.sparkSession.createDataFrame(rows, "c string, t string, k boolean")


def numbered(t: QTable, name: str = ROW) -> DataFrame:
    """The table with its 0-based row numbers in declared order.

    Numbers come from a range partitioning: each partition is sorted and counted alone, then shifted by the rows before
    it, so no task ever holds the table. The sorted partitions are written once (cut); sizes and rows are read from what
    was written, so they cannot differ, whatever is computed again.
    """
    return positions(t.df.orderBy(*t.ordered()), name)


def positions(df: DataFrame, name: str) -> DataFrame:
    """A sorted frame with each row's 0-based position; see numbered."""
    counted = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    counted = cut(counted.withColumn("__k", F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33)))
    sizes = counted.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__b"))  # a row for each partition
    return counted.join(F.broadcast(shifts), "__p").withColumn(name, F.col("__k") + F.col("__b")).drop("__p", "__m", "__k", "__b")
