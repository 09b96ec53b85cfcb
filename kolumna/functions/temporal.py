"""Dates and times: fields, truncation, buckets, month arithmetic that spills over, differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolumna.semantics import col


def field(x, name: str) -> Column:
    """year, mm, dd, hh, minute, ss, dow (Monday is 1), doy, epoch microseconds, of a timestamp or date."""
    x = col(x)
    return {
        "year": lambda: F.year(x), "mm": lambda: F.month(x), "dd": lambda: F.dayofmonth(x), "hh": lambda: F.hour(x), "minute": lambda: F.minute(x),
        "ss": lambda: F.second(x), "dow": lambda: F.weekday(x) + 1, "doy": lambda: F.dayofyear(x), "micros": lambda: F.unix_micros(x.cast("timestamp")),
    }[name]()


def trunc(x, unit: str) -> Column:
    return F.date_trunc(unit, col(x))


def add_months(d, n: int) -> Column:
    """n months later; a day that the month lacks spills into the next one."""
    d = col(d)
    return F.date_add(F.add_months(F.trunc(d, "MM"), n), F.dayofmonth(d) - 1)


def days_between(a, b) -> Column:
    return F.datediff(col(a), col(b))


def seconds_between(a, b) -> Column:
    return (F.unix_micros(col(a).cast("timestamp")) - F.unix_micros(col(b).cast("timestamp"))) / 1_000_000


def plus(ts, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(col(ts).cast("timestamp")) + seconds * 1_000_000)


def tok(kind: str, x) -> Column:
    """Parse a string; what does not parse is null. kind: j long, f double, d date, p timestamp, b boolean."""
    x = F.trim(col(x))
    return x.try_cast({"j": "long", "i": "int", "f": "double", "d": "date", "p": "timestamp", "b": "boolean"}[kind])


def ohlc(price: str, *order: str) -> dict[str, Column]:
    """Open, high, low and close of a bucket's rows."""
    at = F.struct(*order)
    return {"open": F.min_by(price, at), "high": F.max(price), "low": F.min(price), "close": F.max_by(price, at)}
