"""Whole-value comparison, seeded random choices, identifiers, clocks, and digits in any base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolumna.semantics import col


def match(x, y) -> Column:
    """Whether two values are the same, nulls and lists included; values of different types never are."""
    x, y = col(x), y if isinstance(y, Column) else F.lit(y)
    return (F.typeof(x) == F.typeof(y)) & F.coalesce(F.to_json(F.struct(x.alias("v"))) == F.to_json(F.struct(y.alias("v"))), F.lit(False))


def roll(n: int, row, seed: int = 0) -> Column:
    """A number from 0 to n - 1 for each row, from its key and the seed: the same however rows are dealt to tasks."""
    return F.pmod(F.xxhash64(col(row), F.lit(seed)), F.lit(n))


def rand(row, seed: int = 0) -> Column:
    """A number from 0 to 1 for each row, from its key and the seed."""
    return F.pmod(F.xxhash64(col(row), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def deal(df: DataFrame, k: int, row: str, seed: int = 0) -> DataFrame:
    """k different rows, those of smallest seeded hash of their key."""
    return df.orderBy(F.xxhash64(F.col(row), F.lit(seed)), row).limit(k)


def guid(row, seed: int = 0) -> Column:
    """An identifier in the usual 8-4-4-4-12 form for each key and seed."""
    h = F.md5(F.concat_ws(":", col(row).cast("string"), F.lit(str(seed))))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def clock(name: str) -> Column:
    """The time of the query: p (timestamp), d (date), t (milliseconds since midnight), n (microseconds since midnight)."""
    now = F.current_timestamp()
    day = F.unix_micros(now) - F.unix_micros(F.date_trunc("day", now))
    return {"p": now, "d": F.current_date(), "t": F.floor(day / 1000), "n": day}[name]


def to_digits(base: int, x, width: int) -> Column:
    """The last ``width`` digits of a whole number, most significant first."""
    x = col(x)
    return F.array(*[F.floor(x / F.lit(base**k)).cast("long") % base for k in reversed(range(width))])


def from_digits(base: int, digits) -> Column:
    return F.aggregate(col(digits), F.lit(0).cast("long"), lambda acc, d: acc * base + d.cast("long"))
