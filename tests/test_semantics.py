"""Value rules on small frames with nulls, zeros and extremes."""

from pyspark.sql import functions as F

from kolumna import semantics as Q
from kolumna.functions import strings as T
from kolumna.functions import temporal as D


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_null_is_equal_to_null_and_least(spark):
    null = F.lit(None).cast("int")
    r = one(spark, Q.eq(null, null), Q.lt(null, F.lit(1)), Q.lt(F.lit(1), null), Q.le(null, null), Q.gt(F.lit(1), null), Q.within(null, F.lit(0), F.lit(1)))
    assert list(r) == [True, True, False, True, True, False]


def test_division_and_floor(spark):
    r = one(spark, Q.divide(F.lit(1), 0), Q.divide(F.lit(-1), 0), Q.divide(F.lit(0), 0), Q.floor_div(F.lit(-7), 2), Q.floor_mod(F.lit(-7), 3), Q.floor_mod(F.lit(7), 0))
    assert list(r) == [float("inf"), float("-inf"), None, -4, 2, None]


def test_lesser_keeps_null(spark):
    assert list(one(spark, Q.lesser(F.lit(1), F.lit(None).cast("int")), Q.greater(F.lit(1), F.lit(None).cast("int")))) == [None, 1]


def test_halves_round_to_even(spark):
    assert list(one(spark, Q.to_long(F.lit(2.5)), Q.to_long(F.lit(3.5)), Q.to_long(F.lit(-2.5)))) == [2, 4, -2]


def test_tolerant_equality(spark):
    assert list(one(spark, Q.tolerant_eq(F.lit(1.0), 1.0 + 2.0**-45), Q.tolerant_eq(F.lit(1.0), 1.0 + 2.0**-40))) == [True, False]


def test_months_spill_over(spark):
    d = F.lit("2024-01-31").cast("date")
    assert str(one(spark, D.add_months(d, 1))[0]) == "2024-03-02"


def test_globs_and_positions(spark):
    x = F.lit("aaa")
    assert list(one(spark, T.like(x, "a?a"), T.like(x, "[^a]*"), T.like(x, "*a"), T.ss(x, "aa"), T.pad(-2, x), T.pad(5, x))) == [True, False, True, [0, 1], "aa", "aaa  "]
