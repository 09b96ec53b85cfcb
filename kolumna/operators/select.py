"""Functional select, exec, update and delete: (table, constraints, by, phrases) as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolumna.qtable import QTable
from kolumna.semantics import holds

Phrases = dict[str, Column]


@dataclass(frozen=True)
class Folded:
    """A condition on a row and an aggregate over all rows that are left (or those of the row's group)."""

    aggregate: Column
    test: Callable[[Column], Column]


def above(x: Column, times: float, aggregate: Column, or_equal: bool = False) -> Folded:
    """x > times * aggregate (or >=)."""
    return Folded(aggregate, lambda m: x >= times * m if or_equal else x > times * m)


Constraint = Column | Folded


def where(df: DataFrame, constraints: Sequence[Constraint], by: Sequence[str] = ()) -> DataFrame:
    """Rows that pass every constraint, each of which sees only what the previous ones kept.

    A Folded constraint's aggregate is taken over the rows left (within ``by``): folded in every task, then joined back,
    so neither the table nor a group is ever in one task.
    """
    for c in constraints:
        if not isinstance(c, Folded):
            df = df.where(c)  # unknown is dropped as false is; the bare predicate reaches the scan
            continue
        columns = df.columns
        m = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]).agg(c.aggregate.alias("__m"))
        if by:
            same = F.lit(True)
            for i, k in enumerate(by):
                same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
            df = df.join(m, same)
        else:
            df = df.crossJoin(F.broadcast(m))  # one row
        df = df.where(c.test(F.col("__m"))).select(*columns)
    return df


def _checked(names: Sequence[str]) -> None:
    if len(set(names)) < len(names):
        raise ValueError(f"duplicate output names: {names}")


def select(
    t: QTable,
    phrases: Phrases | None = None,
    by: Phrases | None = None,
    constraints: Sequence[Constraint] = (),
    distinct: bool = False,
    limit: int | tuple[int, int] | None = None,
    sort: Sequence[tuple[str, bool]] = (),
) -> QTable:
    """select phrases by ... from t where constraints; clause order: where, sort, limit, by, phrases.

    limit n takes the first n rows (by ``sort``, pairs of column and descending, then the declared order), -n the last n, (m, n) n rows after m. With
    ``by`` the result is keyed and its phrases are aggregates; by without phrases takes each group's last row.
    """
    df = where(t.df, constraints)
    if limit is not None:
        df = _limited(t.with_(df), limit, sort)
    elif sort:
        df = df.orderBy(*_ordering(sort))
    if by:
        _checked([*by, *(phrases or {})])
        keyed = df.withColumns({f"__b{i}": c for i, c in enumerate(by.values())})
        keys = [F.col(f"__b{i}").alias(n) for i, n in enumerate(by)]
        if phrases:
            out = keyed.groupBy(*keys).agg(*[c.alias(n) for n, c in phrases.items()])
        else:
            rest = [c for c in df.columns if c not in by]
            row = F.max_by(F.struct(*rest), F.struct(*t.order) if t.ordered() else None)
            out = keyed.groupBy(*keys).agg(row.alias("__r")).select(*by, "__r.*")
        return QTable(out, tuple(by), ())
    if phrases:
        _checked(list(phrases))
        df = df.select(*[c.alias(n) for n, c in phrases.items()])
    if distinct:
        df = df.distinct()
    return t.with_(df)


Sort = Sequence[tuple[str, bool]]


def _ordering(sort: Sort, backwards: bool = False) -> list[Column]:
    """Ordering columns of (name, descending) pairs: ascending puts nulls first, descending last."""
    return [F.col(n).desc_nulls_last() if d != backwards else F.col(n).asc_nulls_first() for n, d in sort]


def _limited(t: QTable, limit: int | tuple[int, int], sort: Sort) -> DataFrame:
    order = [*sort, *((c, False) for c in t.order if c not in {n for n, _ in sort})]
    if not order:
        t.ordered()
    if isinstance(limit, tuple):
        return t.df.orderBy(*_ordering(order)).offset(limit[0]).limit(limit[1])
    return t.df.orderBy(*_ordering(order, backwards=limit < 0)).limit(abs(limit))


def exec_(t: QTable, phrase: Column, by: Phrases | None = None, constraints: Sequence[Constraint] = ()) -> DataFrame:
    """exec: one column of values, or with ``by`` a list of values per key in declared row order."""
    df = where(t.df, constraints)
    if not by:
        return df.select(phrase.alias("value"))
    pair = F.struct(*t.order, phrase.alias("__v"))
    lists = F.transform(F.sort_array(F.collect_list(pair)), lambda r: r["__v"])
    return df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(lists.alias("value"))


def update(t: QTable, phrases: Phrases, by: Sequence[str] = (), constraints: Sequence[Column] = ()) -> QTable:
    """update phrases by ... from t where ...: rows that pass take the new values, others keep theirs (null if new).

    With ``by`` each phrase is an aggregate over the passing rows of the row's group.
    """
    df, passes = t.df, F.lit(True)
    for c in constraints:
        passes = passes & holds(c)
    df = df.withColumn("__pass", passes)
    values = phrases
    if by:  # groups are folded in every task before they meet, and join back by key: no group is gathered
        of = where(t.df, constraints).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)])
        of = of.agg(*[c.alias(f"__v{i}") for i, c in enumerate(phrases.values())])
        same = F.lit(True)
        for i, k in enumerate(by):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        df = df.join(of, same & F.col("__pass"), "left")
        values = {n: F.col(f"__v{i}") for i, n in enumerate(phrases)}
    new = {}
    for name, value in values.items():
        old = F.col(name) if name in t.df.columns else F.lit(None)
        new[name] = F.when(F.col("__pass"), value).otherwise(old)
    df = df.withColumns(new)
    return t.with_(df.select(*t.df.columns, *[n for n in phrases if n not in t.df.columns]))


def delete(t: QTable, constraints: Sequence[Column] = (), columns: Sequence[str] = ()) -> QTable:
    """Delete columns, or the rows that pass all constraints."""
    if columns:
        if set(columns) >= set(t.df.columns):
            raise ValueError("cannot delete every column")
        return t.with_(t.df.drop(*columns))
    if not constraints:
        return t.with_(t.df.limit(0))
    stays = F.lit(False)
    for c in constraints:  # a row stays if any constraint is false or unknown; written so that it reaches the scan
        stays = stays | ~c | c.isNull()
    return t.with_(t.df.where(stays))


def fby(aggregate: Column, by: Sequence[str]) -> Column:
    """An aggregate per group, given to each row of the group; for use in constraints."""
    return aggregate.over(Window.partitionBy(*by))
