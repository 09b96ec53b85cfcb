"""Strings: globs, matches and replacement, splitting and joining, padding, affixes, character classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolumna.semantics import col


def glob_to_regex(pattern: str, ignore_case: bool = False) -> str:
    """An anchored regular expression for a glob: ? one character, * any run, [..] and [^..] sets."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end]
            flip = body.startswith("^")
            out.append("[" + "^" * flip + re.sub(r"([\\\[\]&~])", r"\\\1", body[flip:]) + "]")
            i = end
        else:
            out.append({"?": ".", "*": ".*"}.get(c, re.escape(c)))
        i += 1
    return ("(?is)" if ignore_case else "(?s)") + "^" + "".join(out) + "$"


def like(x, pattern: str) -> Column:
    return F.coalesce(col(x), F.lit("")).rlike(glob_to_regex(pattern))


def ilike(x, pattern: str) -> Column:
    return F.coalesce(col(x), F.lit("")).rlike(glob_to_regex(pattern, ignore_case=True))


def rlike(x, pattern: str) -> Column:
    return col(x).rlike(pattern)


def full_match(x, pattern: str) -> Column:
    return col(x).rlike(f"^(?:{pattern})$")


def extract(x, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(col(x), pattern, group)


def extract_all(x, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group))


def replace_first(x, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(x), f"(?s)^(.*?)(?:{pattern})", f"$1{by}")


def replace_all(x, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(x), pattern, by)


def split_regex(x, pattern: str) -> Column:
    return F.split(col(x), pattern, -1)


def escape(text: str) -> str:
    return re.escape(text)


def ss(x, needle: str) -> Column:
    """0-based positions of a plain string, overlapping ones too."""
    x = col(x)
    n = len(needle)
    places = F.sequence(F.lit(0), F.greatest(F.length(x) - n, F.lit(0)))
    return F.filter(places, lambda i: F.substring(x, i + 1, F.lit(n)) == needle)


def ssr(x, needle: str, by: str) -> Column:
    return F.replace(col(x), F.lit(needle), F.lit(by))


def vs(delimiter: str, x) -> Column:
    return F.split(col(x), re.escape(delimiter), -1)


def sv(delimiter: str, xs) -> Column:
    return F.array_join(col(xs), delimiter)


def pad(n: int, x) -> Column:
    """To n characters: blanks on the right, for negative n on the left; longer strings are cut."""
    return F.rpad(col(x), n, " ") if n >= 0 else F.when(F.length(col(x)) > -n, F.substring(col(x), 1, -n)).otherwise(F.lpad(col(x), -n, " "))


def strip(x) -> Column:
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def remove_prefix(x, p: str) -> Column:
    return F.when(F.startswith(col(x), F.lit(p)), F.substring(col(x), len(p) + 1, 2**31 - 1)).otherwise(col(x))


def remove_suffix(x, p: str) -> Column:
    return F.when(F.endswith(col(x), F.lit(p)), F.left(col(x), F.length(col(x)) - len(p))).otherwise(col(x))


_CLASSES = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "space": r"\s", "upper": "A-Z", "lower": "a-z"}


def is_class(x, name: str) -> Column:
    """Whether a string is not empty and all of a class: alpha, digit, alnum, space, upper, lower (ASCII)."""
    return F.coalesce(col(x), F.lit("")).rlike(f"^[{_CLASSES[name]}]+$")


def fmt(x, decimals: int) -> Column:
    """The exact binary value in so many decimals, as C prints it; Java would print the shortest decimal that reads back."""
    text = F.udf(lambda v: None if v is None else f"{v:.{decimals}f}", "string", useArrow=True)
    return text(col(x).cast("double"))
