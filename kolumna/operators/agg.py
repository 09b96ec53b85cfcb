"""Aggregates with the value rules of ordered tables: sums over nothing are 0, positional first and last, weighted means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolumna.qtable import QTable
from kolumna.semantics import col


def q_count() -> Column:
    return F.count(F.lit(1))


def q_sum(x) -> Column:
    x = col(x)
    return F.coalesce(F.sum(x), F.lit(0))


def q_sum_bool(x) -> Column:
    return F.coalesce(F.sum(col(x).cast("int")), F.lit(0))


def prd(x) -> Column:
    return F.product(F.coalesce(col(x), F.lit(1)))


def avg(x) -> Column:
    return F.avg(col(x))


def q_min(x) -> Column:
    """The least value; +infinity over nothing."""
    return F.coalesce(F.min(col(x).cast("double")), F.lit(float("inf")))


def q_max(x) -> Column:
    return F.coalesce(F.max(col(x).cast("double")), F.lit(float("-inf")))


def first(x, *order: str) -> Column:
    return F.min_by(col(x), F.struct(*order))


def last(x, *order: str) -> Column:
    return F.max_by(col(x), F.struct(*order))


def med(x) -> Column:
    return F.median(col(x))


def var(x) -> Column:
    return F.var_pop(col(x))


def dev(x) -> Column:
    return F.stddev_pop(col(x))


def svar(x) -> Column:
    return F.when(F.count(col(x)) > 1, F.var_samp(col(x)))


def sdev(x) -> Column:
    return F.when(F.count(col(x)) > 1, F.stddev_samp(col(x)))


def cov(x, y) -> Column:
    return F.covar_pop(col(x), col(y))


def scov(x, y) -> Column:
    return F.covar_samp(col(x), col(y))


def cor(x, y) -> Column:
    both = col(x).isNotNull() & col(y).isNotNull()
    return F.corr(F.when(both, col(x)), F.when(both, col(y)))


def wavg(w, x) -> Column:
    """Sum of w*x over sum of w, over rows where neither is null; null for no weight."""
    both = col(w).isNotNull() & col(x).isNotNull()
    total = F.sum(F.when(both, col(w)))
    return F.when(total != 0, F.sum(F.when(both, col(w) * col(x))) / total)


def wsum(w, x) -> Column:
    return F.coalesce(F.sum(col(w) * col(x)), F.lit(0))


def q_any(x) -> Column:
    return F.coalesce(F.bool_or(col(x).cast("boolean")), F.lit(False))


def q_all(x) -> Column:
    return F.coalesce(F.bool_and(col(x).cast("boolean")), F.lit(True))


def count_distinct(x) -> Column:
    return F.count_distinct(col(x))


def approx_count_distinct(x) -> Column:
    """HyperLogLog with a standard error of about 0.81 %."""
    return F.approx_count_distinct(col(x), 0.0081)


def sketch_distinct(x) -> Column:
    """A mergeable distinct-count sketch (2**14 registers); see hll_union_agg and hll_sketch_estimate."""
    return F.hll_sketch_agg(col(x), F.lit(14))


def top_n(df: DataFrame, by: Sequence[str], x: str, k: int, largest: bool = True) -> DataFrame:
    """The k largest (or smallest) values of x in each group, as an array in that order.

    Ranked by a window whose limit Spark applies in each task before it shuffles, so that large groups stay small.
    """
    from pyspark.sql import Window

    order = F.col(x).desc_nulls_last() if largest else F.col(x).asc_nulls_last()
    ranked = df.where(F.col(x).isNotNull()).select(*by, x).withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    kept = ranked.where(F.col("__n") <= k).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__n", x))).alias("__l"))
    return kept.select(*by, F.transform("__l", lambda r: r[x]).alias(x))


def group(t: QTable, *by: str) -> DataFrame:
    """Value -> row numbers (declared order columns) of its rows, in order."""
    row = F.struct(*t.order) if len(t.order) > 1 else F.col(t.order[0])
    return t.df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def xgroup(t: QTable, *by: str) -> QTable:
    """Key by columns; the others become lists in row order."""
    t.ordered()
    rest = [c for c in t.df.columns if c not in by]
    rows = t.df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*t.order, F.struct(*rest).alias("__r")))).alias("__l"))
    part = lambda c: F.transform("__l", lambda r: r["__r"][c]).alias(c)
    return QTable(rows.select(*by, *[part(c) for c in rest]), tuple(by))


def ungroup(df: DataFrame) -> DataFrame:
    """Rows from parallel list columns; lists of a row must be of equal length."""
    lists = [c for c, t in df.dtypes if t.startswith("array")]
    scalars = [c for c in df.columns if c not in lists]
    size = F.size(lists[0])
    fits = F.lit(True)
    for c in lists[1:]:
        fits = fits & (F.size(c) == size)
    zipped = F.when(fits, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit("ungroup: lists differ in length")))
    return df.select(*scalars, F.explode(zipped).alias("__z")).select(*scalars, *[F.col(f"__z.{c}").alias(c) for c in lists])


def pivot(df: DataFrame, index: Sequence[str], column: str, values: Sequence, aggregate: Column) -> DataFrame:
    """index columns by the given values of a column, one aggregate; a missing cell is 0."""
    return df.groupBy(*index).pivot(column, list(values)).agg(aggregate).fillna(0)


def pivot_long(df: DataFrame, index: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(index), list(columns), name, value)
