"""Datalog over DataFrames: rules with recursion and stratified negation, by semi-naive rounds; an entity store.

An atom is (relation, terms); a term that starts with "?" is a variable, others are constants. A rule is (head, body);
body items are atoms, ("not", atom), or (op, left, right) with op one of < <= > >= = != over variables and constants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolumna.plans.graph import cut

OPS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__", "!=": "__ne__"}
Atom = tuple[str, tuple]


def is_var(t) -> bool:
    return isinstance(t, str) and t.startswith("?")


class Program:
    """Relations (DataFrames with columns c0, c1, ...) and rules."""

    def __init__(self, spark: SparkSession):
        self.spark, self.edb, self.rules = spark, {}, []

    def add(self, name: str, df: DataFrame) -> Program:
        self.edb[name] = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        return self

    def rule(self, head: Atom, *body) -> Program:
        self.rules.append((head, body))
        return self

    def strata(self) -> list[set[str]]:
        """Derived relations in groups that only negate earlier ones; raises if negation is recursive."""
        level = {h[0]: 0 for h, _ in self.rules}
        for _ in range(len(level) ** 2 + 2):
            changed = False
            for (head, _), body in self.rules:
                for item in body:
                    negated = item[0] == "not"
                    name = (item[1] if negated else item)[0]
                    if name in level and level[head] < level[name] + negated:
                        level[head], changed = level[name] + negated, True
            if not changed:
                return [{n for n, k in level.items() if k == i} for i in range(max(level.values(), default=-1) + 1)]
        raise ValueError("negation within recursion")

    def _atom(self, df: DataFrame, terms: tuple) -> DataFrame:
        """Rows that fit the atom, with a column per variable."""
        columns: dict[str, Column] = {}
        for i, t in enumerate(terms):
            c = F.col(f"c{i}")
            if not is_var(t):
                df = df.where(c == t)
            elif t in columns:
                df = df.where(c == columns[t])
            else:
                columns[t] = c
        return df.select(*[c.alias(v[1:]) for v, c in columns.items()])

    def _body(self, head: Atom, body, tables: dict[str, DataFrame], delta: tuple[int, DataFrame] | None) -> DataFrame:
        out: DataFrame | None = None
        for i, item in enumerate(body):
            if item[0] == "not" or item[0] in OPS:
                continue
            part = self._atom(delta[1] if delta and delta[0] == i else tables[item[0]], item[1])
            shared = [c for c in part.columns if out is not None and c in out.columns]
            out = part if out is None else out.join(part, shared) if shared else out.crossJoin(part)
        for item in body:
            if item[0] == "not":
                part = self._atom(tables[item[1][0]], item[1][1])
                out = out.join(part.distinct(), part.columns, "left_anti")
            elif item[0] in OPS:
                a, b = (F.col(t[1:]) if is_var(t) else F.lit(t) for t in item[1:])
                out = out.where(getattr(a, OPS[item[0]])(b))
        return out.select(*[(F.col(t[1:]) if is_var(t) else F.lit(t)).alias(f"c{i}") for i, t in enumerate(head[1])])

    def eval(self) -> dict[str, DataFrame]:
        """All relations, derived ones to their fix-point: each round joins only what the last round added."""
        tables = dict(self.edb)
        for stratum in self.strata():
            rules = [(h, b) for h, b in self.rules if h[0] in stratum]
            new: dict[str, DataFrame] = {}
            for h, b in rules:
                if not any(item[0] in stratum for item in b):
                    part = self._body(h, b, tables, None)
                    new[h[0]] = new[h[0]].union(part) if h[0] in new else part
            delta = {n: cut(d.distinct()) for n, d in new.items()}
            for n, d in delta.items():
                tables[n] = cut(tables[n].union(d).distinct()) if n in tables else d
            recursive = [(h, b) for h, b in rules if any(item[0] in stratum for item in b)]
            while recursive and any(not d.isEmpty() for d in delta.values()):
                made: dict[str, DataFrame] = {}
                for h, b in recursive:
                    for i, item in enumerate(b):
                        if item[0] in delta and all(x[0] in tables for x in b if x[0] not in OPS and x[0] != "not"):
                            part = self._body(h, b, tables, (i, delta[item[0]]))
                            made[h[0]] = made[h[0]].union(part) if h[0] in made else part
                delta = {}
                for n, d in made.items():
                    d = d.distinct()
                    d = cut(d.join(tables[n], d.columns, "left_anti") if n in tables else d)
                    tables[n] = cut(tables[n].union(d)) if n in tables else d
                    delta[n] = d
        return tables

    def query(self, find: Sequence[str], *where) -> DataFrame:
        """Variables that satisfy the conditions."""
        head = ("__q", tuple(find))
        return self._body(head, where, self.eval(), None).toDF(*[v[1:] for v in find]).distinct()


class Entities:
    """An entity-attribute-value table: assert, retract, scan and pull."""

    def __init__(self, df: DataFrame):
        self.df = df.toDF("e", "a", "v")

    def assert_(self, rows: DataFrame) -> Entities:
        return Entities(self.df.union(rows).distinct())

    def retract(self, rows: DataFrame) -> Entities:
        return Entities(self.df.join(rows.toDF("e", "a", "v"), ["e", "a", "v"], "left_anti"))

    def scan(self, a: str) -> DataFrame:
        return self.df.where(F.col("a") == a)

    def pull(self, *attributes: str) -> DataFrame:
        """A row per entity with its attributes as columns (the smallest of several values)."""
        return self.df.groupBy("e").pivot("a", list(attributes)).agg(F.min("v"))
