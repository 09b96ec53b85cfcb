"""Window functions and running, moving and neighbouring values over a declared row order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kolumna.qtable import QTable, numbered
from kolumna.semantics import col
from kolumna.session import cut


class Order:
    """Partition and order of a table's rows, from which the verbs below make their frames."""

    def __init__(self, order: Sequence[str], by: Sequence[str] = ()):
        self.by, self.order = list(by), list(order)
        self.all: WindowSpec = Window.partitionBy(*(self.by or [F.lit(0)])).orderBy(*[F.col(c).asc_nulls_first() for c in order])
        self.running = self.all.rowsBetween(Window.unboundedPreceding, 0)

    def trailing(self, n: int) -> WindowSpec:
        return self.all.rowsBetween(-(n - 1), 0)

    def whole(self) -> WindowSpec:
        return self.all.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    # running values
    def sums(self, x) -> Column:
        return F.sum(F.coalesce(col(x), F.lit(0))).over(self.running)

    def prds(self, x) -> Column:
        return F.product(F.coalesce(col(x), F.lit(1))).over(self.running)

    def maxs(self, x) -> Column:
        return F.coalesce(F.max(col(x)).over(self.running), F.lit(float("-inf")))

    def mins(self, x) -> Column:
        return F.coalesce(F.min(col(x)).over(self.running), F.lit(float("inf")))

    def avgs(self, x) -> Column:
        return F.avg(col(x)).over(self.running)

    def fills(self, x) -> Column:
        return F.last(col(x), ignorenulls=True).over(self.running)

    # neighbours
    def prev(self, x) -> Column:
        return F.lag(col(x)).over(self.all)

    def next(self, x) -> Column:
        return F.lead(col(x)).over(self.all)

    def xprev(self, n: int, x) -> Column:
        return F.lag(col(x), n).over(self.all) if n >= 0 else F.lead(col(x), -n).over(self.all)

    def row_number(self) -> Column:
        return F.row_number().over(self.all)

    def deltas(self, x) -> Column:
        return F.when(self.row_number() == 1, col(x)).otherwise(col(x) - self.prev(x))

    def ratios(self, x) -> Column:
        """Each value over the one before, the first itself; null for a zero or null divisor."""
        before = self.prev(x)
        return F.when(self.row_number() == 1, col(x)).when(before != 0, col(x) / before)

    def differ(self, x) -> Column:
        return F.when(self.row_number() == 1, F.lit(True)).otherwise(~col(x).eqNullSafe(self.prev(x)))

    # moving values
    def msum(self, n: int, x) -> Column:
        return F.sum(F.coalesce(col(x), F.lit(0))).over(self.trailing(n))

    def mcount(self, n: int, x) -> Column:
        return F.count(col(x)).over(self.trailing(n))

    def mavg(self, n: int, x) -> Column:
        return F.avg(col(x)).over(self.trailing(n))

    def mmax(self, n: int, x) -> Column:
        return F.coalesce(F.max(col(x)).over(self.trailing(n)), F.lit(float("-inf")))

    def mmin(self, n: int, x) -> Column:
        """The least of the window; null if it holds a null."""
        nulls = F.count(F.when(col(x).isNull(), 1)).over(self.trailing(n))
        return F.when(nulls == 0, F.min(col(x)).over(self.trailing(n)))

    def mdev(self, n: int, x) -> Column:
        return F.stddev_pop(col(x)).over(self.trailing(n))

    # positions
    def rank(self) -> Column:
        return F.rank().over(self.all)

    def dense_rank(self) -> Column:
        return F.dense_rank().over(self.all)

    def ntile(self, n: int) -> Column:
        return F.ntile(n).over(self.all)

    def xrank(self, n: int) -> Column:
        """Bucket of n by position: floor(n * position / count)."""
        count = F.count(F.lit(1)).over(self.whole())
        return F.floor(n * (self.row_number() - 1) / count)

    def position(self) -> Column:
        """0-based place in ascending order, ties in row order."""
        return self.row_number() - 1

    def first_value(self, x) -> Column:
        return F.first(col(x)).over(self.running)

    def last_value(self, x) -> Column:
        return F.last(col(x)).over(self.whole())

    def nth_value(self, x, n: int) -> Column:
        return F.nth_value(col(x), n).over(self.whole())

    def sessions(self, ts, gap_seconds: int) -> Column:
        """Number of the session: a row starts one if the time since the row before exceeds the gap."""
        t = F.unix_micros(col(ts).cast("timestamp"))
        starts = F.when(t - F.lag(t).over(self.all) > gap_seconds * 1_000_000, 1).otherwise(0)
        return F.sum(starts).over(self.running)


def with_sessions(df: DataFrame, o: Order, ts: str, gap_seconds: int, name: str = "session") -> DataFrame:
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    df = df.withColumn("__new", F.when(t - F.lag(t).over(o.all) > gap_seconds * 1_000_000, 1).otherwise(0))
    return df.withColumn(name, F.sum("__new").over(o.running)).drop("__new")


def ema(df: DataFrame, o: Order, a: float, x: str, name: str = "ema", block: int = 100_000) -> DataFrame:
    """Exponential moving average e = a*x + (1-a)*e, starting at the first value; nulls count as 0.

    A recurrence that no frame expresses. Rows are numbered in their group and cut into blocks; pandas folds each block
    from 0, and the value that the block before ends with, times (1-a) to the number of rows, is added. Such block ends
    are themselves a recurrence over few rows, so a group of any size is spread over many tasks.
    """
    rows = df.withColumn("__n", F.row_number().over(o.all) - 1) if o.by else numbered(QTable(df, order=tuple(o.order)), "__n")
    rows = rows.withColumn("__b", F.floor(F.col("__n") / block))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{name}` double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n")
        v = pdf[x].fillna(0).astype("float64") * a
        if pdf["__n"].iloc[0] == 0:
            v.iloc[0] /= a
        # e[i] = v[i] + (1 - a) * e[i - 1], from 0: the adjusted mean's numerator without its weights
        e = np.empty(len(v))
        last = 0.0
        for i, value in enumerate(v.to_numpy()):
            last = e[i] = value + (1 - a) * last
        return pdf.assign(**{name: e})

    own = cut(rows.groupBy(*o.by, "__b").applyInPandas(fold, schema))
    ends = own.groupBy(*o.by, "__b").agg(F.max_by(F.col(name), F.col("__n")).alias("__e"), F.count(F.lit(1)).alias("__c"))
    ordered = Window.partitionBy(*o.by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.struct("__e", "__c")).over(ordered)  # a row for each block
    carry = F.aggregate(before, F.lit(0.0), lambda acc, r: r["__e"] + F.pow(F.lit(1.0 - a), r["__c"].cast("double")) * acc)
    carries = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(o.by)], F.col("__b").alias("__kb"), carry.alias("__carry"))
    same = F.col("__b") == F.col("__kb")
    for i, k in enumerate(o.by):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    whole = own.join(carries, same)
    value = F.col(name) + F.pow(F.lit(1.0 - a), (F.col("__n") % block + 1).cast("double")) * F.col("__carry")
    return whole.select(*df.columns, value.alias(name))
