"""Joins: keyed first-match joins, equi, union, plus and as-of joins, window joins, anti and semi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolumna.qtable import QTable
from kolumna.session import cut


def first_match(y: QTable) -> DataFrame:
    """A keyed table with one row per key: the first in declared order (or as it is, if no order is declared)."""
    if not y.order:
        return y.df.dropDuplicates(list(y.keys))
    rest = [c for c in y.df.columns if c not in y.keys]
    return y.df.groupBy(*y.keys).agg(F.min_by(F.struct(*rest), F.struct(*y.order)).alias("__r")).select(*y.keys, "__r.*")


def _keyed(x: QTable, y: QTable, how: str, fills: bool) -> QTable:
    keys = list(y.keys)
    right = first_match(y)
    values = [c for c in right.columns if c not in keys]
    right = right.select(*keys, *[F.col(c).alias(f"__y_{c}") for c in values], F.lit(True).alias("__hit"))
    joined = x.df.join(right, keys, how)
    out = []
    for c in [*x.df.columns, *[v for v in values if v not in x.df.columns]]:
        if c not in values:
            out.append(F.col(c))
        elif c not in x.df.columns:
            out.append(F.col(f"__y_{c}").alias(c))
        elif fills:
            out.append(F.coalesce(f"__y_{c}", c).alias(c))
        else:
            out.append(F.when(F.col("__hit"), F.col(f"__y_{c}")).otherwise(F.col(c)).alias(c))
    return x.with_(joined.select(*out))


def lj(x: QTable, y: QTable) -> QTable:
    """Left join to a keyed table: on a match, shared columns come from y, nulls included."""
    return _keyed(x, y, "left", False)


def ljf(x: QTable, y: QTable) -> QTable:
    """As lj, but a null of y leaves x's value."""
    return _keyed(x, y, "left", True)


def ij(x: QTable, y: QTable) -> QTable:
    """Rows of x with a match in keyed y, first match per key."""
    return _keyed(x, y, "inner", False)


def ijf(x: QTable, y: QTable) -> QTable:
    return _keyed(x, y, "inner", True)


def pj(x: QTable, y: QTable) -> QTable:
    """Plus join: shared value columns are x + y, y counting as 0 where it has no match."""
    keys, right = list(y.keys), first_match(y)
    values = [c for c in right.columns if c not in keys]
    joined = x.df.join(right.select(*keys, *[F.col(c).alias(f"__y_{c}") for c in values]), keys, "left")
    add = lambda c: (F.col(c) + F.coalesce(F.col(f"__y_{c}"), F.lit(0))).alias(c)
    new = [F.col(f"__y_{c}").alias(c) for c in values if c not in x.df.columns]
    return x.with_(joined.select(*[add(c) if c in values else F.col(c) for c in x.df.columns], *new))


def ej(keys: Sequence[str], x: DataFrame, y: DataFrame) -> DataFrame:
    """Equi join, every matching pair; value columns in both come from y."""
    mine = [c for c in x.columns if c in keys or c not in y.columns]
    return x.select(*mine).join(y, list(keys), "inner")


def uj(x: QTable, y: QTable, fills: bool = False) -> QTable:
    """Union join. Without keys: rows of both, absent columns null. Keyed: y updates matching keys, others are added."""
    if not y.keys:
        return QTable(x.df.unionByName(y.df, allowMissingColumns=True))
    keys = list(y.keys)
    left = x.df.select(*keys, F.struct(*[c for c in x.df.columns if c not in keys]).alias("__x"))
    right = first_match(y).select(*keys, F.struct(*[c for c in y.df.columns if c not in keys]).alias("__y"))
    both = left.join(right, keys, "full")
    xs, ys = [c for c in x.df.columns if c not in keys], [c for c in y.df.columns if c not in keys]
    out = []
    for c in [*xs, *[v for v in ys if v not in xs]]:
        a, b = (F.col(f"__x.{c}") if c in xs else F.lit(None)), (F.col(f"__y.{c}") if c in ys else None)
        if b is None:
            out.append(a.alias(c))
        else:
            out.append((F.coalesce(b, a) if fills else F.when(F.col("__y").isNotNull(), b).otherwise(a)).alias(c))
    return QTable(both.select(*keys, *out), tuple(keys))


def ujf(x: QTable, y: QTable) -> QTable:
    """As uj, but nulls of y do not overwrite."""
    return uj(x, y, fills=True)


def upsert(x: QTable, rows: QTable) -> QTable:
    """Keyed: the last of the payload's rows per key updates or is added. Without keys: rows are appended."""
    if not x.keys:
        return QTable(x.df.unionByName(rows.df, allowMissingColumns=True), (), x.order)
    keys = list(x.keys)
    rest = [c for c in rows.df.columns if c not in keys]
    order = F.struct(*rows.order) if rows.ordered() else None
    last = rows.df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
    return uj(x, QTable(last, x.keys))


def insert(x: QTable, rows: DataFrame) -> QTable:
    """Append; of a keyed table no key may be there already (checked)."""
    if x.keys and not rows.join(x.df, list(x.keys), "left_semi").isEmpty():
        raise ValueError("insert: key exists")
    return x.with_(x.df.unionByName(rows))


def asof_rows(
    x: QTable, y: QTable, keys: Sequence[str], buckets: int | None = None
) -> tuple[DataFrame, list[str]]:
    """x with __m: the last row of y with equal keys (all but the last) and time <= x's time, as a struct, or null.

    One sort of both sides together, no join: y's rows come before x's at equal times, ties of y in y's order. With
    ``buckets`` (seconds), the time is cut into buckets, each a partition of its own, and the last row of y before a
    bucket is carried into it; use it where a few keys hold most rows. Without equal keys, ranges of the time are such
    buckets always, so that the tables do not meet in one task.
    """
    *equal, time = keys
    y.ordered()
    values = [c for c in y.df.columns if c not in equal]
    left = x.df.withColumn("__row_x", F.struct(*x.df.columns))
    left = left.select(*equal, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__o"), "__row_x")
    right = y.df.dropna(subset=[*equal, time]) if equal else y.df.dropna(subset=[time])
    tie = F.row_number().over(Window.partitionBy(*equal, time).orderBy(*y.ordered())) if len(y.order) else F.lit(0)
    right = right.withColumn("__o", F.lpad(tie.cast("string"), 12, "0"))
    right = right.select(*equal, F.col(time).alias("__t"), F.lit(0).alias("__side"), "__o", F.struct(*values).alias("__y"))
    both = left.unionByName(right, allowMissingColumns=True)
    if not equal:
        part = ["__b"]
        both = cut(both.repartitionByRange(F.col("__t").asc_nulls_first()).withColumn("__b", F.spark_partition_id()))
        ends = both.groupBy("__b").agg(F.max_by("__y", F.when(F.col("__side") == 0, F.struct("__t", "__o"))).alias("__end"))
        before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        carried = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
        both = both.join(F.broadcast(carried), part)
    elif buckets:
        both = both.withColumn("__b", F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / (buckets * 1_000_000)))
        part = [*equal, "__b"]
        last = right.withColumn("__b", F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / (buckets * 1_000_000)))
        ends = last.groupBy(*part).agg(F.max_by("__y", F.struct("__t", "__o")).alias("__end"))
        seen = both.select(*part).distinct().join(ends, part, "left")
        before = Window.partitionBy(*equal).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = seen.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).select(*part, "__carry")
        both = both.join(carried, part)
    else:
        part = list(equal)
    run = Window.partitionBy(*part).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    m = F.last("__y", ignorenulls=True).over(run)
    both = both.withColumn("__m", F.coalesce(m, F.col("__carry")) if buckets or not equal else m)
    out = both.where("__side = 1").select("__row_x.*", "__m")
    for k in equal:  # null keys never match
        out = out.withColumn("__m", F.when(F.col(k).isNotNull(), F.col("__m")))
    return out.withColumn("__m", F.when(F.col(time).isNotNull(), F.col("__m"))), values


def aj(keys: Sequence[str], x: QTable, y: QTable, zero: bool = False, fills: bool = False, buckets: int | None = None) -> QTable:
    """As-of join: x with the values of the last y row at or before its time; zero (aj0): y's time replaces x's.

    Shared columns come from y (null on a miss); fills (ajf) keeps x's value where y has null or no row.
    """
    time = keys[-1]
    df, values = asof_rows(x, y, keys, buckets)
    out = []
    for c in [*x.df.columns, *[v for v in values if v not in x.df.columns]]:
        if c == time:
            out.append(F.coalesce(F.col(f"__m.{time}"), F.col(time)).alias(c) if zero else F.col(c))
        elif c in values and c not in keys:
            own = F.col(f"__m.{c}")
            out.append((F.coalesce(own, F.col(c)) if fills and c in x.df.columns else own).alias(c))
        else:
            out.append(F.col(c))
    return x.with_(df.select(*out))


def asof(x: QTable, y: QTable, keys: Sequence[str]) -> DataFrame:
    """Only y's remaining columns for each row of x's keys (null row on a miss), beside x's declared order."""
    df, values = asof_rows(x, y, keys)
    return df.select(*x.order, *[F.col(f"__m.{c}").alias(c) for c in values if c not in keys])


def wj(
    x: QTable,
    y: QTable,
    keys: Sequence[str],
    lo: Column,
    hi: Column,
    aggregates: dict[str, Column],
    step: int,
    prevailing: bool = True,
) -> DataFrame:
    """Window join: x with aggregates over the rows of y of equal keys whose time lies in [lo, hi].

    lo and hi are expressions over x; aggregates are over y's columns. Time is cut into buckets of ``step`` seconds, to
    which both sides are joined by equality, so that no key is ever crossed with itself. prevailing (wj): the last row of
    y before lo counts too, where none lies at lo itself; without it (wj1) only rows inside.
    """
    *equal, time = keys
    id_ = "__id"
    left = x.df.withColumn(id_, F.struct(*x.order)).withColumn("__lo", lo).withColumn("__hi", hi)
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (step * 1_000_000))
    spans = left.select(*equal, id_, "__lo", "__hi").withColumn("__b", F.explode(F.sequence(bucket("__lo"), bucket("__hi"))))
    right = y.df.dropna(subset=list(keys)).withColumn("__b", bucket(time)).withColumnRenamed(time, "__t")
    inside = spans.join(right, [*equal, "__b"]).where("__t between __lo and __hi").drop("__b", "__lo", "__hi")
    if prevailing:
        starts = QTable(left.select(*equal, F.col("__lo").alias(time), id_), order=(id_,))
        before, values = asof_rows(starts, y, keys)
        at_lo = before.where("__m is not null").select(*equal, id_, F.col(f"__m.{time}").alias("__t"), F.col(time).alias("__lo"), *[F.col(f"__m.{v}").alias(v) for v in values if v != time])
        inside = inside.unionByName(at_lo.where("__t < __lo").drop("__lo"), allowMissingColumns=True)
    folded = inside.groupBy(id_).agg(*[c.alias(n) for n, c in aggregates.items()])
    return left.join(folded, id_, "left").select(*x.df.columns, *aggregates)


def anti(keys: Sequence[str], x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of x without a match; rows with a null key have none and stay."""
    return x.join(y.select(*keys).distinct(), list(keys), "left_anti")


def semi(keys: Sequence[str], x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select(*keys).distinct(), list(keys), "left_semi")


def cross(x: DataFrame, y: DataFrame) -> DataFrame:
    """Every pair of rows; meant for small tables."""
    return x.crossJoin(y)


def lookup(kt: QTable, keys: DataFrame) -> DataFrame:
    """The value rows of a keyed table for a table of keys (null row on a miss)."""
    return keys.join(first_match(kt), list(kt.keys), "left")


def deref(x: DataFrame, link: str, target: DataFrame, row: str, fields: Sequence[str]) -> DataFrame:
    """Fields of the target row that a linking column points to."""
    chosen = target.select(F.col(row).alias(link), *[F.col(f).alias(f"{link}_{f}") for f in fields])
    return x.join(chosen, link, "left")


def multiway(*atoms: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """All bindings of a conjunctive pattern: each atom is a table and the names of the variables that its columns bind.

    Atoms are first reduced by semi joins on what they share with each neighbour, forwards and backwards, which removes
    rows without a partner before anything grows; then they are joined, each to one that shares a variable with it. A
    pattern whose atoms do not hang together is refused, as it would be a product.
    """
    left = []
    for df, names in atoms:
        if len(names) != len(df.columns):
            raise ValueError("an atom names every column of its table")
        names = list(names)
        for i, n in enumerate(names):  # a variable that stands twice in an atom
            if names.index(n) < i:
                df = df.where(F.col(df.columns[i]) == F.col(df.columns[names.index(n)]))
        left.append(df.select(*[F.col(df.columns[names.index(n)]).alias(n) for n in dict.fromkeys(names)]).distinct())
    order = [left.pop(0)]
    bound = set(order[0].columns)
    while left:
        nxt = next((d for d in left if bound & set(d.columns)), None)
        if nxt is None:
            raise ValueError("the atoms do not hang together")
        left = [d for d in left if d is not nxt]
        order.append(nxt)
        bound |= set(nxt.columns)

    def reduced(dfs: list[DataFrame]) -> list[DataFrame]:
        out = [dfs[0]]
        for d in dfs[1:]:
            near = next((o for o in reversed(out) if set(o.columns) & set(d.columns)), None)
            shared = [c for c in d.columns if near is not None and c in near.columns]
            out.append(d.join(near.select(*shared).distinct(), shared, "left_semi") if shared else d)
        return out

    order = reduced(order)
    order = reduced(order[::-1])[::-1]
    whole = order[0]
    for d in order[1:]:
        whole = whole.join(d, [c for c in d.columns if c in whole.columns])
    return whole


def wco_triangles(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Triangles x < y < z of an undirected graph: each edge runs from the endpoint of lower degree, which bounds the paths."""
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    degree = e.select("u").union(e.select("v")).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(degree.withColumnRenamed("d", "du"), "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    low = F.struct("du", "u") < F.struct(F.col("dv").alias("du"), F.col("v").alias("u"))
    e = cut(e.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("p"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("q")))
    one, two = e.select("p", F.col("q").alias("q1")), e.select("p", F.col("q").alias("q2"))
    paths = one.join(two, "p").where("q1 < q2")
    closed = paths.join(e.select(F.least("p", "q").alias("q1"), F.greatest("p", "q").alias("q2")), ["q1", "q2"])
    ends = F.sort_array(F.array("p", "q1", "q2"))
    return closed.select(ends[0].alias("x"), ends[1].alias("y"), ends[2].alias("z"))
