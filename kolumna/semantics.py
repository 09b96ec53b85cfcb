"""Value rules that differ from SQL's: two-valued comparison, IEEE division, floor division, folds over nothing.

Null equals null and is smaller than every value, so a predicate is never unknown. Division yields infinities instead of
errors. Integer division and remainder round towards minus infinity. A sum over nothing is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def eq(x, y) -> Column:
    return col(x).eqNullSafe(y)


def ne(x, y) -> Column:
    return ~col(x).eqNullSafe(y)


def lt(x, y) -> Column:
    x, y = col(x), y if isinstance(y, Column) else F.lit(y)
    return F.when(y.isNull(), F.lit(False)).when(x.isNull(), F.lit(True)).otherwise(x < y)


def le(x, y) -> Column:
    return ~lt(y if isinstance(y, Column) else F.lit(y), col(x))


def gt(x, y) -> Column:
    return lt(y if isinstance(y, Column) else F.lit(y), col(x))


def ge(x, y) -> Column:
    return ~lt(col(x), y)


def tolerant_eq(x, y, ulp: float = 2.0**-43) -> Column:
    """Equality of finite floats up to a relative tolerance of 2**-43; other values exactly, nulls as equal."""
    x, y = col(x), y if isinstance(y, Column) else F.lit(y)
    near = F.abs(x - y) <= ulp * F.greatest(F.abs(x), F.abs(y))
    return x.eqNullSafe(y) | F.coalesce(near, F.lit(False))


def holds(p: Column) -> Column:
    """A predicate as a two-valued one: unknown counts as false."""
    return F.coalesce(p, F.lit(False))


def divide(x, y) -> Column:
    """Float division by IEEE rules: x/0 is an infinity of x's sign, 0/0 is null (not a number)."""
    x, y = col(x).cast("double"), (y if isinstance(y, Column) else F.lit(y)).cast("double")
    return F.when(y == 0, F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))).otherwise(x / y)


def floor_div(x, y) -> Column:
    x, y = col(x), y if isinstance(y, Column) else F.lit(y)
    return F.when(y != 0, F.floor(x / y))


def floor_mod(x, y) -> Column:
    """The remainder with the divisor's sign; null for a zero divisor."""
    x, y = col(x), y if isinstance(y, Column) else F.lit(y)
    return F.when(y != 0, x - y * F.floor(x / y))


def lesser(x, y) -> Column:
    """The smaller of two values, where null is the smallest."""
    x, y = col(x), y if isinstance(y, Column) else F.lit(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.least(x, y))


def greater(x, y) -> Column:
    return F.greatest(col(x), y if isinstance(y, Column) else F.lit(y))


def fill(x, value) -> Column:
    return F.coalesce(col(x), value if isinstance(value, Column) else F.lit(value))


def is_null(x) -> Column:
    """Null, or not a number, or the empty string."""
    x = col(x)
    return x.isNull() | F.coalesce(F.isnan(x.try_cast("double")), F.lit(False)) | (x.cast("string") == "")


def negate_truth(x) -> Column:
    return eq(x, 0) if not isinstance(x, bool) else F.lit(not x)


def to_long(x) -> Column:
    """Float to integer, halves to even."""
    return F.bround(col(x).cast("double")).cast("long")


def xbar(n, x) -> Column:
    """x rounded down to a multiple of n. For temporal x, n is in seconds (at most a microsecond's precision)."""
    return n * F.floor(col(x) / n)


def xbar_time(seconds: int, ts) -> Column:
    """A timestamp rounded down to a multiple of so many seconds since 1970."""
    micros = F.unix_micros(col(ts).cast("timestamp"))
    return F.timestamp_micros(F.floor(micros / (seconds * 1_000_000)).cast("long") * (seconds * 1_000_000))


def within(x, lo, hi) -> Column:
    """lo <= x <= hi, ends included; null is below every value."""
    return ge(x, lo) & le(x, hi)


def signum(x) -> Column:
    return F.signum(col(x)).cast("int")


def ifelse(p: Column, x, y) -> Column:
    return F.when(holds(p), x).otherwise(y)


def rounded(x, decimals: int) -> Column:
    """Binary rounding, halves away from zero, by scaling up and down; -0.0 stays negative. Spark's round() goes by the
    decimal text instead and rounds 1.005 up. What cannot be scaled is left alone."""
    x = col(x).cast("double")
    size = F.round(F.abs(x) * 10.0**decimals, 0) / 10.0**decimals
    huge = F.isnan(x) | (F.abs(x) * 10.0**decimals == float("inf"))
    return F.when(huge, x).when((x < 0) | (x.cast("string") == "-0.0"), -size).otherwise(size)
