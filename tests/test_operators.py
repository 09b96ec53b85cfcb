"""Joins, windows, grouping and plans on small frames with ties, nulls and empty sides."""

import pytest
from pyspark.sql import functions as F

from kolumna.operators import agg as A
from kolumna.operators import joins as J
from kolumna.operators import select as S
from kolumna.operators.window import Order
from kolumna.plans import graph as G
from kolumna.plans.datalog import Program
from kolumna.qtable import QTable, numbered


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_left_join_takes_nulls_of_a_match(spark):
    x = QTable(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"))
    y = QTable(spark.createDataFrame([(1, None, 0), (1, "z", 1), (2, "y", 0)], "k int, v string, o int"), ("k",), ("o",))
    y = QTable(y.df, ("k",), ("o",))
    out = J.lj(x, y).df.select("k", "v")
    assert rows(out, "k") == [(1, None), (2, "y"), (3, "c")]
    assert rows(J.ljf(x, y).df.select("k", "v"), "k") == [(1, "a"), (2, "y"), (3, "c")]


def test_asof_ties_take_the_last_row_and_null_keys_never_match(spark):
    x = QTable(spark.createDataFrame([(1, "s", 5), (2, "s", 1), (3, None, 5)], "id int, k string, t int"), (), ("id",))
    y = QTable(spark.createDataFrame([(1, "s", 2, 10), (2, "s", 5, 20), (3, "s", 5, 30), (4, None, 1, 40)], "o int, k string, t int, p int"), (), ("o",))
    out = J.aj(["k", "t"], x, y).df.select("id", "t", "p")
    assert rows(out, "id") == [(1, 5, 30), (2, 1, None), (3, 5, None)]
    assert rows(J.aj(["k", "t"], x, y, zero=True).df.select("id", "t"), "id") == [(1, 5), (2, 1), (3, 5)]


def test_upsert_last_of_the_payload_wins(spark):
    x = QTable(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ("k",))
    p = QTable(spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 3)], "k int, v string, o int"), (), ("o",))
    assert rows(J.upsert(x, p).df.select("k", "v"), "k") == [(1, "a"), (2, "d"), (3, "e")]


def test_order_must_be_declared(spark):
    with pytest.raises(ValueError):
        numbered(QTable(spark.range(3).toDF("a")))


def test_row_numbers_follow_the_declared_order(spark):
    t = QTable(spark.range(1000).select((999 - F.col("id")).alias("a")).repartition(7), (), ("a",))
    assert rows(numbered(t, "i").select("a", "i"), "a") == [(k, k) for k in range(1000)]


def test_running_and_moving_with_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 3.0)], "i int, x double")
    o = Order(["i"])
    out = df.select("i", o.sums("x"), o.fills("x"), o.mmin(2, "x"), o.mmax(2, "x"), o.deltas("x"))
    assert rows(out, "i") == [(1, 2.0, 2.0, 2.0, 2.0, 2.0), (2, 2.0, 2.0, None, 2.0, None), (3, 5.0, 3.0, None, 3.0, None)]


def test_sums_over_nothing(spark):
    e = spark.range(0).toDF("x")
    assert tuple(e.agg(A.q_sum("x"), A.q_min("x"), A.q_all(F.col("x") > 0), A.q_any(F.col("x") > 0)).first()) == (0, float("inf"), True, False)


def test_duplicate_names_are_refused(spark):
    t = QTable(spark.range(1).toDF("a"))
    with pytest.raises(ValueError):
        S.select(t, {"b": F.col("a")}, by={"b": F.col("a")})


def test_ungroup_needs_equal_lengths(spark):
    df = spark.createDataFrame([([1, 2], [1])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="length"):
        A.ungroup(df).collect()


def test_shortest_paths_and_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (7, 8, 1.0)], "src long, dst long, weight double")
    assert G.shortest_path(e, 1, 3) == [1, 3]
    assert rows(G.dijkstra(e, 1).select("node", "dist"), "node") == [(1, 0.0), (2, 1.0), (3, 2.0)]
    assert rows(G.connected(e), "node") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert [d for d, _ in G.k_shortest(e, 1, 3, 3)] == [2.0, 5.0]


def test_recursive_negation_is_refused(spark):
    p = Program(spark).add("n", spark.range(2).toDF("a"))
    p.rule(("p", ("?x",)), ("n", ("?x",)), ("not", ("p", ("?x",))))
    with pytest.raises(ValueError):
        p.eval()
