"""Lists, dictionaries, JSON, adverbs over arrays, small matrices, codecs."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolumna.semantics import col

MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))


# lists
def til(n) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def where_true(xs) -> Column:
    """Indices of the true items."""
    return F.filter(F.transform(col(xs), lambda v, i: F.when(v, i)), lambda i: i.isNotNull())


def find(xs, y) -> Column:
    """0-based index of y, or the length."""
    at = F.array_position(col(xs), y)
    return F.when(at > 0, at - 1).otherwise(F.size(col(xs)))


def index(xs, i) -> Column:
    """Item at a 0-based index; null outside."""
    return F.get(col(xs), i if isinstance(i, Column) else F.lit(i))


def take(n: int, xs) -> Column:
    """First n items, cycling when short; last -n."""
    xs = col(xs)
    if n < 0:
        return F.slice(xs, F.greatest(F.size(xs) + n + 1, F.lit(1)), F.least(F.lit(-n), F.size(xs)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(xs, F.pmod(i, F.size(xs))))


def drop(n: int, xs) -> Column:
    xs = col(xs)
    return F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0))) if n >= 0 else F.slice(xs, F.lit(1), F.greatest(F.size(xs) + n, F.lit(0)))


def cut(n: int, xs) -> Column:
    xs = col(xs)
    chunks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int"))
    return F.transform(chunks, lambda i: F.slice(xs, i * n + 1, F.lit(n)))


def rotate(n: int, xs) -> Column:
    xs = col(xs)
    return F.transform(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: F.get(xs, F.pmod(i + n, F.size(xs))))


def reverse(xs) -> Column:
    return F.reverse(col(xs))


def raze(xss) -> Column:
    return F.flatten(col(xss))


def bin_(xs, y) -> Column:
    """Index of the last item of a sorted list that is not above y; -1 if none."""
    return F.size(F.filter(col(xs), lambda v: v <= y)) - 1


def binr(xs, y) -> Column:
    """Index of the first item of a sorted list that is not below y."""
    return F.size(F.filter(col(xs), lambda v: v < y))


def amend(xs, i: int, f: Callable[[Column], Column]) -> Column:
    """The list with f applied to the item at an index."""
    return F.transform(col(xs), lambda v, k: F.when(k == i, f(v)).otherwise(v))


# adverbs
def each(f: Callable[[Column], Column], xs) -> Column:
    return F.transform(col(xs), f)


def over(f: Callable[[Column, Column], Column], start: Column, xs) -> Column:
    return F.aggregate(col(xs), start, f)


def scan(f: Callable[[Column, Column], Column], start: Column, xs, kind: str) -> Column:
    """All intermediate results of a fold.

    A growing list is copied with every item, so a list is cut in blocks of about the square root of its length: a fold
    of each block gives what the next one starts from, then each block gathers its own results.
    """
    xs, none = col(xs), F.array().cast(f"array<{kind}>")
    each_new = lambda a, x: f(a, x).cast(kind)
    width = F.greatest(F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / width).cast("int"), F.lit(0))), lambda i: F.slice(xs, i * width + 1, width))

    def gathered(over, first: Column, new, kept) -> Column:
        """The list of kept(old, new) over the steps of a fold."""
        step = lambda acc, x: F.struct(new(acc["last"], x).alias("last"), F.concat(acc["all"], F.array(kept(acc["last"], x))).alias("all"))
        return F.aggregate(over, F.struct(first.alias("last"), none.alias("all")), step, lambda acc: acc["all"])

    starts = gathered(blocks, start.cast(kind), lambda a, block: F.aggregate(block, a, each_new), lambda a, _: a)
    return F.flatten(F.zip_with(blocks, starts, lambda block, first: gathered(block, first, each_new, each_new)))


def prior(f: Callable[[Column, Column], Column], xs) -> Column:
    """f of each item and the one before (null before the first)."""
    xs = col(xs)
    return F.transform(xs, lambda v, i: f(v, F.get(xs, i - 1)))


def each_both(f: Callable[[Column, Column], Column], xs, ys) -> Column:
    return F.zip_with(col(xs), col(ys), f)


# dictionaries
def dict_of(keys, values) -> Column:
    return F.map_from_arrays(col(keys), col(values))


def dict_drop(d, *keys: str) -> Column:
    return F.map_filter(col(d), lambda k, v: ~k.isin(*keys))


def dict_add(a, b) -> Column:
    """Key union; values of shared keys are added."""
    return F.map_zip_with(col(a), col(b), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def str_to_dict(x, pair: str, key: str) -> Column:
    return F.str_to_map(col(x), F.lit(pair), F.lit(key))


# JSON
def json_field(x, path: str) -> Column:
    return F.get_json_object(col(x), path)


def json_of(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


# codecs
def digest(x, name: str) -> Column:
    x = col(x).cast("binary")
    return F.md5(x) if name == "md5" else F.sha1(x) if name == "sha1" else F.sha2(x, 256)


def btoa(x) -> Column:
    return F.base64(col(x).cast("binary"))


def atob(x) -> Column:
    return F.unbase64(col(x)).cast("string")


@F.pandas_udf(T.BinaryType())
def gz(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else gzip.compress(v if isinstance(v, bytes) else v.encode(), mtime=0))


@F.pandas_udf(T.StringType())
def gunzip(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else gzip.decompress(v).decode())


def base36(x) -> Column:
    return F.conv(col(x).cast("string"), 10, 36)


# small matrices, row by row, as lists of lists
@F.pandas_udf(MATRIX)
def mmu(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(np.stack(x) @ np.stack(y)).tolist() for x, y in zip(a, b)])


@F.pandas_udf(MATRIX)
def inv(a: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.inv(np.stack(x)).tolist() for x in a])


@F.pandas_udf(MATRIX)
def lsq(y: pd.Series, a: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.lstsq(np.stack(m).T, np.stack(v).T, rcond=None)[0].T.tolist() for v, m in zip(y, a)])
