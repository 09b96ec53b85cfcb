"""Queries for select, exec, update, delete, aggregates, joins, windows, sorting, set operations and shaping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.operators import agg as A
from kolumna.operators import joins as J
from kolumna.operators import select as S
from kolumna.operators import setops, shape, sort
from kolumna.operators.window import Order, ema, with_sessions
from kolumna.qtable import QTable, numbered
from kolumna.queries.registry import Tables, query

CUTOFF = dt.datetime(1998, 9, 2)


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,"
    " round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem"
    " WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"
)
def select_by_agg(t: Tables) -> DataFrame:
    phrases = {
        "sum_qty": F.round(A.q_sum("l_quantity"), 2),
        "avg_price": F.round(A.avg("l_extendedprice"), 4),
        "revenue": F.round(A.q_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2),
        "n": A.q_count(),
    }
    by = {c: F.col(c) for c in ("l_returnflag", "l_linestatus")}
    return S.select(t.q("lineitem"), phrases, by, [F.col("l_shipdate") <= F.lit(CUTOFF).cast("timestamp_ntz")]).df


@query(
    "WITH a AS (SELECT * FROM lineitem WHERE l_quantity > 25), b AS (SELECT *, avg(l_extendedprice) OVER () AS m FROM a)"
    " SELECT l_orderkey, l_linenumber, l_extendedprice FROM b WHERE l_extendedprice > 1.5 * m"
)
def where_refine(t: Tables) -> DataFrame:
    kept = S.where(t.lineitem, [F.col("l_quantity") > 25, S.above(F.col("l_extendedprice"), 1.5, F.avg("l_extendedprice"))])
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'O'),"
    " b AS (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM a)"
    " SELECT o_custkey, o_orderkey, o_totalprice FROM b WHERE o_totalprice = m"
)
def where_fby_after_filter(t: Tables) -> DataFrame:
    best = S.where(t.orders, [F.col("o_orderstatus") == "O", S.above(F.col("o_totalprice"), 1.0, F.max("o_totalprice"), or_equal=True)], ["o_custkey"])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t: Tables) -> DataFrame:
    cols = {c: F.col(c) for c in ("o_orderstatus", "o_orderpriority")}
    return S.select(t.q("orders"), cols, distinct=True).df


@query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def exec_distinct(t: Tables) -> DataFrame:
    return S.exec_(t.q("customer"), F.col("c_mktsegment")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_sort_limit(t: Tables) -> DataFrame:
    return S.select(t.q("orders", "o_orderkey"), {c: F.col(c) for c in ("o_orderkey", "o_totalprice")}, limit=20, sort=[("o_totalprice", True)]).df


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 50")
def select_first_n(t: Tables) -> DataFrame:
    return S.select(t.q("events", "event_id"), {c: F.col(c) for c in ("event_id", "user_id")}, limit=50).df


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 30")
def select_last_n(t: Tables) -> DataFrame:
    return S.select(t.q("events", "event_id"), {c: F.col(c) for c in ("event_id", "user_id")}, limit=-30).df


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 10 OFFSET 100")
def select_n_after_m(t: Tables) -> DataFrame:
    return S.select(t.q("events", "event_id"), {c: F.col(c) for c in ("event_id", "value")}, limit=(100, 10)).df


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_retailprice = m")
def fby_max_price(t: Tables) -> DataFrame:
    df = t.part.withColumn("m", S.fby(F.max("p_retailprice"), ["p_brand"]))
    return df.where("p_retailprice = m").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN round(p_retailprice * 0.9, 4) ELSE p_retailprice END AS p_retailprice FROM part")
def update_where(t: Tables) -> DataFrame:
    new = S.update(t.q("part"), {"p_retailprice": F.round(F.col("p_retailprice") * 0.9, 4)}, constraints=[F.col("p_size") > 25])
    return new.df.select("p_partkey", "p_retailprice")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(sum(o_totalprice) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey), 2) END AS total FROM orders"
)
def update_by(t: Tables) -> DataFrame:
    new = S.update(t.q("orders"), {"total": F.sum("o_totalprice")}, by=["o_custkey"], constraints=[F.col("o_orderstatus") == "F"])
    return new.df.select("o_orderkey", F.round("total", 2).alias("total"))


@query("SELECT * FROM supplier WHERE NOT (s_acctbal < 0)")
def delete_rows(t: Tables) -> DataFrame:
    return S.delete(t.q("supplier"), [F.col("s_acctbal") < 0]).df


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def delete_columns(t: Tables) -> DataFrame:
    return S.delete(t.q("supplier"), columns=["s_name", "s_acctbal"]).df


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_row_by_key(t: Tables) -> DataFrame:
    return S.select(t.q("events", "event_id"), by={"user_id": F.col("user_id")}).df.select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_by_group(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(A.first("user_id", "event_id").alias("user_id"))


@query("SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1] AS head, list(o_orderkey ORDER BY o_orderkey)[-1] AS tail FROM orders GROUP BY 1")
def exec_by(t: Tables) -> DataFrame:
    df = S.exec_(t.q("orders", "o_orderkey"), F.col("o_orderkey"), {"o_custkey": F.col("o_custkey")})
    return df.select("o_custkey", F.size("value").cast("long").alias("n"), F.get("value", F.lit(0)).alias("head"), F.element_at("value", -1).alias("tail"))


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1) AS i, event_id FROM events")
def virtual_row_number(t: Tables) -> DataFrame:
    return numbered(t.q("events", "event_id"), "i").select(F.col("i").cast("long").alias("i"), "event_id")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END AS kind FROM part")
def vector_conditional(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") > 20, "big").otherwise("small").alias("kind"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 10000 AND 50000")
def in_within(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(10000, 50000)).select("o_orderkey")


# aggregates
@query(
    "SELECT l_returnflag, round(median(l_quantity), 4) AS med, round(var_pop(l_quantity), 4) AS var, round(stddev_pop(l_quantity), 4) AS dev,"
    " round(var_samp(l_quantity), 4) AS svar, round(stddev_samp(l_quantity), 4) AS sdev, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1"
)
def agg_moments(t: Tables) -> DataFrame:
    r = lambda c, n: F.round(c, 4).alias(n)
    return t.lineitem.groupBy("l_returnflag").agg(
        r(A.med("l_quantity"), "med"), r(A.var("l_quantity"), "var"), r(A.dev("l_quantity"), "dev"), r(A.svar("l_quantity"), "svar"), r(A.sdev("l_quantity"), "sdev"),
        A.q_min("l_quantity").alias("lo"), A.q_max("l_quantity").alias("hi"),
    )


@query(
    "SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS cor, round(covar_pop(l_quantity, l_extendedprice), 2) AS cov,"
    " round(covar_samp(l_quantity, l_extendedprice), 2) AS scov, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS wavg,"
    " round(sum(l_quantity * l_discount), 2) AS wsum FROM lineitem GROUP BY 1"
)
def agg_pairs(t: Tables) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    return t.lineitem.groupBy("l_linestatus").agg(
        F.round(A.cor(x, y), 6).alias("cor"), F.round(A.cov(x, y), 2).alias("cov"), F.round(A.scov(x, y), 2).alias("scov"),
        F.round(A.wavg(x, y), 4).alias("wavg"), F.round(A.wsum(x, "l_discount"), 2).alias("wsum"),
    )


@query("SELECT o_custkey, round(product(1 + o_totalprice / 1e9), 9) AS prd, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_orderstatus = 'F') AS all_f FROM orders GROUP BY 1")
def agg_prd_any_all(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.round(A.prd(1 + F.col("o_totalprice") / 1e9), 9).alias("prd"), A.q_any(F.col("o_orderstatus") == "F").alias("any_f"), A.q_all(F.col("o_orderstatus") == "F").alias("all_f")
    )


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(A.count_distinct("user_id").alias("users"), A.q_count().alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS close FROM lineitem GROUP BY 1")
def approx_distinct(t: Tables) -> DataFrame:
    """The exact count, and whether the estimate is within 3 % of it."""
    # a sketch counts a repeated value once, so it is built after repetitions are gone: beside a distinct aggregate it would be kept for every value
    once = t.lineitem.select("l_returnflag", "l_partkey").distinct()
    both = once.groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"), A.approx_count_distinct("l_partkey").alias("about"))
    return both.select("l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) <= 0.03 * F.col("parts")).alias("close"))


@query("SELECT count(DISTINCT l_partkey) AS parts, true AS close FROM lineitem")
def sketch_distinct(t: Tables) -> DataFrame:
    """Sketches by group, merged: the exact count, and whether the estimate is within 3 % of it."""
    parts = t.lineitem.groupBy("l_returnflag").agg(A.sketch_distinct("l_partkey").alias("s"))
    about = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("about"))
    exact = t.lineitem.agg(A.count_distinct("l_partkey").alias("parts"))
    return exact.crossJoin(about).select("parts", (F.abs(F.col("about") - F.col("parts")) <= 0.03 * F.col("parts")).alias("close"))  # one row each


@query("SELECT p_brand, unnest(list_slice(list(p_retailprice ORDER BY p_retailprice DESC), 1, 3)) AS price FROM part GROUP BY 1")
def top_n_per_group(t: Tables) -> DataFrame:
    return A.top_n(t.part, ["p_brand"], "p_retailprice", 3).select("p_brand", F.explode("p_retailprice").alias("price"))


@query("SELECT p_brand, unnest(list_slice(list(p_retailprice ORDER BY p_retailprice), 1, 2)) AS price FROM part GROUP BY 1")
def bottom_n_per_group(t: Tables) -> DataFrame:
    return A.top_n(t.part, ["p_brand"], "p_retailprice", 2, largest=False).select("p_brand", F.explode("p_retailprice").alias("price"))


@query("SELECT event_type, len(list(event_id)) AS n, list(event_id ORDER BY event_id)[1] AS first_row FROM events GROUP BY 1")
def group_rows(t: Tables) -> DataFrame:
    g = A.group(t.q("events", "event_id"), "event_type")
    return g.select("event_type", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0)).alias("first_row"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def xgroup_ungroup(t: Tables) -> DataFrame:
    nested = A.xgroup(t.q("orders", "o_orderkey"), "o_custkey").df.select("o_custkey", "o_orderkey", "o_totalprice")
    return A.ungroup(nested)


@query(
    "SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS O, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS F FROM lineitem GROUP BY 1"
)
def pivot_linestatus(t: Tables) -> DataFrame:
    p = A.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", ["O", "F"], F.sum("l_quantity"))
    return p.select("l_returnflag", F.round("O", 2).alias("O"), F.round("F", 2).alias("F"))


@query("SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_suppkey, l_returnflag)")
def rollup_counts(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_suppkey", "l_returnflag").agg(A.q_count().alias("n"))


# joins
NATION = "(SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 3 <> 0)"


def _nation(t: Tables) -> QTable:
    return QTable(t.nation.where("n_nationkey % 3 <> 0").withColumnRenamed("n_nationkey", "c_nationkey"), ("c_nationkey",), ("c_nationkey",))


@query(f"SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN {NATION} n ON c_nationkey = n_nationkey")
def lj_first_match(t: Tables) -> DataFrame:
    return J.lj(t.q("customer"), _nation(t)).df.select("c_custkey", "c_nationkey", "n_name", "n_regionkey")


@query(f"SELECT c_custkey, coalesce(n_name, c_name) AS c_name FROM customer LEFT JOIN {NATION} n ON c_nationkey = n_nationkey")
def ljf_fill(t: Tables) -> DataFrame:
    kt = _nation(t)
    return J.ljf(t.q("customer"), QTable(kt.df.withColumnRenamed("n_name", "c_name"), kt.keys, kt.order)).df.select("c_custkey", "c_name")


@query(f"SELECT c_custkey, n_name FROM customer JOIN {NATION} n ON c_nationkey = n_nationkey")
def ij_first_match(t: Tables) -> DataFrame:
    return J.ij(t.q("customer"), _nation(t)).df.select("c_custkey", "n_name")


@query("SELECT s_suppkey, round(s_acctbal + coalesce(m, 0), 2) AS s_acctbal FROM supplier LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS m FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON s_nationkey = c_nationkey")
def pj_plus(t: Tables) -> DataFrame:
    best = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.max("c_acctbal").alias("s_acctbal"))
    return J.pj(t.q("supplier"), QTable(best, ("s_nationkey",))).df.select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def ej_pairs(t: Tables) -> DataFrame:
    return J.ej(["o_custkey"], t.orders, t.customer.withColumnRenamed("c_custkey", "o_custkey")).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT s_nationkey AS k, s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_nationkey, c_name, NULL, c_mktsegment FROM customer")
def uj_stack(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    return J.uj(QTable(a), QTable(b)).df


KEYED = "a AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal < 5000), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) END AS name FROM customer WHERE c_acctbal > 0)"


def _keyed_pair(t: Tables) -> tuple[QTable, QTable]:
    c = t.customer
    a = c.where("c_acctbal < 5000").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).alias("name"))
    return QTable(a, ("k",), ("k",)), QTable(b, ("k",), ("k",))


@query(f"WITH {KEYED} SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.name ELSE a.name END AS name, bal FROM a FULL JOIN b ON a.k = b.k")
def uj_keyed(t: Tables) -> DataFrame:
    return J.uj(*_keyed_pair(t)).df


@query(f"WITH {KEYED} SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, bal FROM a FULL JOIN b ON a.k = b.k")
def ujf_keyed(t: Tables) -> DataFrame:
    return J.ujf(*_keyed_pair(t)).df


@query(f"WITH {KEYED} SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, bal FROM a FULL JOIN b ON a.k = b.k")
def keyed_coalesce(t: Tables) -> DataFrame:
    return shape.coalesce(*_keyed_pair(t)).df


@query(
    "WITH l AS (SELECT user_id AS k, arg_max(value, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), x AS (SELECT user_id AS k, min(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)"
    " SELECT coalesce(x.k, l.k) AS k, CASE WHEN l.k IS NOT NULL THEN l.v ELSE x.v END AS v FROM x FULL JOIN l ON x.k = l.k"
)
def upsert_last_wins(t: Tables) -> DataFrame:
    base = t.events.where("event_id % 2 = 1").groupBy(F.col("user_id").alias("k")).agg(F.min("value").alias("v"))
    new = t.events.where("event_id % 2 = 0").select(F.col("user_id").alias("k"), F.col("value").alias("v"), "event_id")
    rows = QTable(new, (), ("event_id",))
    return J.upsert(QTable(base, ("k",)), rows).df.select("k", "v")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join(t: Tables) -> DataFrame:
    return J.anti(["c_custkey"], t.customer, t.orders.where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return J.semi(["c_custkey"], t.customer, big).select("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_small(t: Tables) -> DataFrame:
    return J.cross(t.region.select("r_name"), t.nation.select("n_name"))


@query("SELECT n_nationkey, n_name, r_name AS region_r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def linked_column(t: Tables) -> DataFrame:
    n = t.nation.withColumnRenamed("n_regionkey", "region")
    return J.deref(n, "region", t.region, "r_regionkey", ["r_name"]).select("n_nationkey", "n_name", "region_r_name")


@query("SELECT k.n_regionkey, r_name FROM (SELECT DISTINCT n_regionkey FROM nation) k LEFT JOIN region ON n_regionkey = r_regionkey")
def keyed_lookup(t: Tables) -> DataFrame:
    kt = QTable(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), ("n_regionkey",), ("n_regionkey",))
    return J.lookup(kt, t.nation.select("n_regionkey").distinct())


@query("SELECT o_orderkey, c_custkey, c_acctbal FROM orders FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def full_join(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 5000")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "full").select("o_orderkey", "c_custkey", "c_acctbal")


CLICKS = "c AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, value AS price, event_id AS pid FROM events WHERE event_type = 'purchase')"


def _clicks(t: Tables) -> tuple[QTable, QTable]:
    e = t.events
    c = e.where("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    p = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"), F.col("event_id").alias("pid"))
    return QTable(c, (), ("event_id",)), QTable(p, (), ("pid",))


@query(f"WITH {CLICKS} SELECT c.event_id, c.user_id, c.ts, c.value, p.price, p.pid FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def aj_events(t: Tables) -> DataFrame:
    return J.aj(["user_id", "ts"], *_clicks(t)).df


@query(f"WITH {CLICKS} SELECT c.event_id, c.user_id, coalesce(p.ts, c.ts) AS ts, c.value, p.price, p.pid FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def aj0_events(t: Tables) -> DataFrame:
    return J.aj(["user_id", "ts"], *_clicks(t), zero=True).df


@query(f"WITH {CLICKS} SELECT c.event_id, coalesce(p.price, c.value) AS value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def ajf_events(t: Tables) -> DataFrame:
    c, p = _clicks(t)
    return J.aj(["user_id", "ts"], c, QTable(p.df.withColumnRenamed("price", "value"), (), p.order), fills=True).df.select("event_id", "value")


@query(f"WITH {CLICKS} SELECT c.event_id, c.user_id, c.ts, c.value, p.price, p.pid FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def aj_bucketed(t: Tables) -> DataFrame:
    return J.aj(["user_id", "ts"], *_clicks(t), buckets=86400).df


@query(f"WITH {CLICKS} SELECT c.event_id, p.price, p.pid FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def asof_lookup(t: Tables) -> DataFrame:
    c, p = _clicks(t)
    return J.asof(c, p, ["user_id", "ts"])


DAY = "INTERVAL 1 DAY"


@query(
    f"WITH {CLICKS} SELECT c.event_id, count(p.pid) AS n, round(sum(p.price), 4) AS total, max(p.price) AS top FROM c LEFT JOIN p"
    f" ON c.user_id = p.user_id AND p.ts BETWEEN c.ts - {DAY} AND c.ts + {DAY} GROUP BY 1"
)
def wj1_events(t: Tables) -> DataFrame:
    return _window_join(t, prevailing=False)


@query(
    f"WITH {CLICKS}, w AS (SELECT c.event_id, p.pid, p.price FROM c JOIN p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts - {DAY} AND c.ts + {DAY}),"
    f" b AS (SELECT c.event_id, p.pid, p.price FROM (SELECT event_id, user_id, ts - {DAY} AS lo FROM c) c ASOF JOIN p ON c.user_id = p.user_id AND c.lo >= p.ts),"
    " u AS (SELECT * FROM w UNION SELECT * FROM b)"
    " SELECT c.event_id, count(u.pid) AS n, round(sum(u.price), 4) AS total, max(u.price) AS top FROM c LEFT JOIN u ON c.event_id = u.event_id GROUP BY 1"
)
def wj_prevailing(t: Tables) -> DataFrame:
    return _window_join(t, prevailing=True)


def _window_join(t: Tables, prevailing: bool) -> DataFrame:
    c, p = _clicks(t)
    day = F.expr("INTERVAL 1 DAY")
    aggregates = {"n": F.count("pid"), "total": F.sum("price"), "top": F.max("price")}
    out = J.wj(c, p, ["user_id", "ts"], F.col("ts") - day, F.col("ts") + day, aggregates, 86400, prevailing)
    return out.select("event_id", F.coalesce("n", F.lit(0)).alias("n"), F.round("total", 4).alias("total"), "top")


# windows and running values
W = "(PARTITION BY user_id ORDER BY event_id)"
RUN = "(PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(
    f"SELECT event_id, round(sum(value) OVER {RUN}, 4) AS sums, max(value) OVER {RUN} AS maxs, min(value) OVER {RUN} AS mins, round(avg(value) OVER {RUN}, 9) AS avgs,"
    f" round(value - CASE WHEN row_number() OVER {W} = 1 THEN 0 ELSE lag(value) OVER {W} END, 4) AS deltas FROM events"
)
def running(t: Tables) -> DataFrame:
    o = Order(["event_id"], ["user_id"])
    r = lambda c, n: F.round(c, 4).alias(n)
    return t.events.select("event_id", r(o.sums("value"), "sums"), o.maxs("value").alias("maxs"), o.mins("value").alias("mins"), F.round(o.avgs("value"), 9).alias("avgs"), r(o.deltas("value"), "deltas"))


M5 = "(PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)"


@query(
    f"SELECT event_id, round(sum(value) OVER {M5}, 4) AS msum, count(value) OVER {M5} AS mcount, round(avg(value) OVER {M5}, 9) AS mavg, max(value) OVER {M5} AS mmax,"
    f" min(value) OVER {M5} AS mmin, round(stddev_pop(value) OVER {M5}, 3) AS mdev FROM events"
)
def moving(t: Tables) -> DataFrame:
    o = Order(["event_id"], ["user_id"])
    r = lambda c, n, d=4: F.round(c, d).alias(n)
    return t.events.select(
        "event_id", r(o.msum(5, "value"), "msum"), o.mcount(5, "value").alias("mcount"), r(o.mavg(5, "value"), "mavg", 9), o.mmax(5, "value").alias("mmax"),
        o.mmin(5, "value").alias("mmin"), r(o.mdev(5, "value"), "mdev", 3),
    )


@query(
    f"SELECT event_id, lag(value) OVER {W} AS prev, lead(value) OVER {W} AS next, lag(value, 3) OVER {W} AS xprev, (row_number() OVER {W} = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER {W}) AS differ,"
    f" round(CASE WHEN row_number() OVER {W} = 1 THEN value WHEN lag(value) OVER {W} <> 0 THEN value / lag(value) OVER {W} END, 9) AS ratios FROM events"
)
def neighbours(t: Tables) -> DataFrame:
    o = Order(["event_id"], ["user_id"])
    return t.events.select(
        "event_id", o.prev("value").alias("prev"), o.next("value").alias("next"), o.xprev(3, "value").alias("xprev"), o.differ("event_type").alias("differ"),
        F.round(o.ratios("value"), 9).alias("ratios"),
    )


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER {RUN} AS filled FROM events")
def fills(t: Tables) -> DataFrame:
    o = Order(["event_id"], ["user_id"])
    df = t.events.withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return df.select("event_id", o.fills("p").alias("filled"))


@query(
    "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, ntile(4) OVER w AS nt, lag(o_totalprice) OVER w AS lg, lead(o_totalprice) OVER w AS ld,"
    " first_value(o_totalprice) OVER f AS fv, last_value(o_totalprice) OVER f AS lv, nth_value(o_totalprice, 2) OVER f AS nv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey),"
    " p AS (PARTITION BY o_custkey ORDER BY o_orderpriority), f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
)
def rank_functions(t: Tables) -> DataFrame:
    o, p = Order(["o_orderkey"], ["o_custkey"]), Order(["o_orderpriority"], ["o_custkey"])
    big = lambda c, n: c.cast("long").alias(n)
    x = "o_totalprice"
    return t.orders.select(
        "o_orderkey", big(o.row_number(), "rn"), big(p.rank(), "rk"), big(p.dense_rank(), "dr"), big(o.ntile(4), "nt"), o.prev(x).alias("lg"), o.next(x).alias("ld"),
        F.first(x).over(o.whole()).alias("fv"), o.last_value(x).alias("lv"), o.nth_value(x, 2).alias("nv"),
    )


@query(
    "SELECT p_partkey, floor(5 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) / count(*) OVER (PARTITION BY p_brand))::BIGINT AS bucket,"
    " row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part"
)
def xrank_rank(t: Tables) -> DataFrame:
    o = Order(["p_retailprice", "p_partkey"], ["p_brand"])
    return t.part.select("p_partkey", o.xrank(5).cast("long").alias("bucket"), o.position().cast("long").alias("place"))


@query(
    "WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT user_id, event_id, k, value AS ema FROM e WHERE k = 1"
    " UNION ALL SELECT e.user_id, e.event_id, e.k, 0.3 * e.value + 0.7 * r.ema FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, round(ema, 6) AS ema FROM r"
)
def ema_events(t: Tables) -> DataFrame:
    return ema(t.events.select("user_id", "event_id", "value"), Order(["event_id"], ["user_id"]), 0.3, "value").select("event_id", F.round("ema", 6).alias("ema"))


@query(
    "WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS s FROM events)"
    " SELECT event_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM n"
)
def session_idiom(t: Tables) -> DataFrame:
    return with_sessions(t.events, Order(["ts"], ["user_id"]), "ts", 86400).select("event_id", F.col("session").cast("long").alias("session"))


# order, take, drop, search
@query("SELECT (row_number() OVER (ORDER BY s_acctbal, k) - 1) AS position, k AS row FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier)")
def iasc_grade(t: Tables) -> DataFrame:
    return sort.iasc(t.q("supplier", "s_suppkey"), "s_acctbal").select(F.col("position").cast("long").alias("position"), F.col("row").cast("long").alias("row"))


@query("SELECT r_regionkey, r_name, count(*) AS n FROM (SELECT r_regionkey, r_name, unnest(range(12)) AS i FROM region) WHERE r_regionkey + 5 * i < 12 GROUP BY ALL")
def take_cyclic(t: Tables) -> DataFrame:
    return sort.take(t.q("region", "r_regionkey"), 12).groupBy("r_regionkey", "r_name").agg(A.q_count().alias("n"))


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 7")
def drop_first(t: Tables) -> DataFrame:
    return sort.drop(t.q("nation", "n_nationkey"), 7).select("n_nationkey")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 20")
def drop_last(t: Tables) -> DataFrame:
    return sort.drop(t.q("nation", "n_nationkey"), -5).select("n_nationkey")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 6 OFFSET 4")
def sublist_range(t: Tables) -> DataFrame:
    return sort.sublist(t.q("nation", "n_nationkey"), 4, 6).select("n_nationkey")


@query("SELECT n_nationkey, ((row_number() OVER (ORDER BY n_nationkey) - 1) // 4)::BIGINT AS chunk FROM nation")
def cut_chunks(t: Tables) -> DataFrame:
    return sort.cut(t.q("nation", "n_nationkey"), 4).select("n_nationkey", F.col("chunk").cast("long").alias("chunk"))


@query("SELECT n_nationkey, ((row_number() OVER (ORDER BY n_nationkey) - 1 - 3 + 25) % 25)::BIGINT AS position FROM nation")
def rotate_rows(t: Tables) -> DataFrame:
    return sort.rotate(t.q("nation", "n_nationkey"), 3).select("n_nationkey", F.col("position").cast("long").alias("position"))


@query("WITH p AS (SELECT p_retailprice AS price, max(n) AS n FROM (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS n FROM part) GROUP BY 1) SELECT o_orderkey, coalesce(n, -1) AS bin FROM (SELECT o_orderkey, o_totalprice / 100 AS x FROM orders) ASOF LEFT JOIN p ON x >= price")
def bin_search(t: Tables) -> DataFrame:
    values = t.orders.select("o_orderkey", (F.col("o_totalprice") / 100).alias("p_retailprice"))
    return sort.bin_(t.q("part", "p_retailprice", "p_partkey"), values, "p_retailprice").select("o_orderkey", F.col("bin").cast("long").alias("bin"))


# sets and shape
@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union(t: Tables) -> DataFrame:
    return setops.union(t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_inter(t: Tables) -> DataFrame:
    return setops.inter(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_except(t: Tables) -> DataFrame:
    return setops.except_(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def set_union_all(t: Tables) -> DataFrame:
    return setops.union_all(t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")))


@query("SELECT r_regionkey, 'r_name' AS \"column\", r_name AS value FROM region")
def flip_columns(t: Tables) -> DataFrame:
    return shape.flip(t.region, "r_regionkey")


@query("SELECT * FROM (VALUES ('r_regionkey', 'int', true), ('r_name', 'string', false)) v(c, t, k)")
def meta_table(t: Tables) -> DataFrame:
    return QTable(t.region).xkey("r_regionkey").meta()


@query("SELECT p_partkey, upper(p_brand) AS up FROM part")
def on_distinct_values(t: Tables) -> DataFrame:
    return shape.on_distinct(t.part, "p_brand", F.upper, "up").select("p_partkey", "up")


@query("SELECT r_regionkey AS id, r_name AS label FROM region")
def rename_reorder(t: Tables) -> DataFrame:
    return QTable(t.region).xcol(["id", "label"]).xcols("label").df


