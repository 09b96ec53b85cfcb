"""Queries for sorting, inserting, remaining joins and verbs, files, the provider, views, and user functions."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna import semantics
from kolumna.functions import nested as N
from kolumna.functions import strings as T
from kolumna.functions import values as V
from kolumna.operators import joins as J
from kolumna.operators import select as S
from kolumna.operators import sort
from kolumna.operators.views import Views
from kolumna.operators.window import Order
from kolumna.qtable import QTable, positions
from kolumna.queries.extended import _folder
from kolumna.queries.registry import Tables, query
from kolumna.sources import files, provider


# sorting
@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size, p_partkey) - 1 AS position FROM part")
def xasc_parts(t: Tables) -> DataFrame:
    return positions(sort.xasc(t.q("part", "p_partkey"), "p_brand", "p_size"), "position").select("p_partkey", "position")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS position FROM part")
def xdesc_parts(t: Tables) -> DataFrame:
    return positions(sort.xdesc(t.q("part", "p_partkey"), "p_retailprice"), "position").select("p_partkey", "position")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS position FROM orders")
def reverse_orders(t: Tables) -> DataFrame:
    return positions(sort.reverse(t.q("orders", "o_orderkey")), "position").select("o_orderkey", "position")


@query("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position, row FROM (SELECT c_acctbal, c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer)")
def idesc_grade(t: Tables) -> DataFrame:
    return sort.idesc(t.q("customer", "c_custkey"), "c_acctbal")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, count(*) OVER () AS c FROM events) WHERE n <= c - 100")
def drop_last_events(t: Tables) -> DataFrame:
    return sort.drop(t.q("events", "event_id"), -100).select("event_id")


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts) - 1) // 64)::BIGINT AS chunk FROM events")
def cut_events(t: Tables) -> DataFrame:
    return sort.cut(t.q("events", "ts"), 64).select("event_id", F.col("chunk").cast("long").alias("chunk"))


# joins and tables
@query("SELECT c_custkey, coalesce(n_name, c_name) AS c_name FROM customer JOIN (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_name END AS n_name FROM nation WHERE n_regionkey < 4) ON c_nationkey = k")
def ijf_fill(t: Tables) -> DataFrame:
    right = t.nation.where("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("c_name"))
    return J.ijf(t.q("customer", "c_custkey"), QTable(right, ("c_nationkey",), ("c_nationkey",))).df.select("c_custkey", "c_name")


@query(
    "WITH x AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click'), y AS (SELECT user_id, ts AS since, CASE WHEN value > 50 THEN value END AS v FROM events WHERE event_type <> 'click')"
    " SELECT event_id, epoch_us(coalesce(since, ts)) AS ts, coalesce(v, value) AS value FROM x ASOF LEFT JOIN y ON x.user_id = y.user_id AND x.ts >= y.since"
)
def ajf0_events(t: Tables) -> DataFrame:
    e = t.events
    x = QTable(e.where("event_type = 'click'").select("user_id", "ts", "event_id", "value"), order=("event_id",))
    y = QTable(e.where("event_type <> 'click'").select("user_id", "ts", F.when(F.col("value") > 50, F.col("value")).alias("value")), order=("ts",))
    return J.aj(["user_id", "ts"], x, y, zero=True, fills=True).df.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def insert_rows(t: Tables) -> DataFrame:
    nation = QTable(t.nation.select("n_nationkey", "n_name"), ("n_nationkey",), ("n_nationkey",))
    return J.insert(nation, t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))).df


@query("SELECT DISTINCT c_custkey, o_orderkey, l_partkey, s_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey")
def multiway_cycle(t: Tables) -> DataFrame:
    """Customer, order, item and supplier, closed by the nation."""
    found = J.multiway(
        (t.customer.select("c_custkey", "c_nationkey"), ("c", "n")),
        (t.orders.select("o_orderkey", "o_custkey"), ("o", "c")),
        (t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), ("o", "p", "s")),
        (t.supplier.select("s_suppkey", "s_nationkey"), ("s", "n")),
    )
    return found.select(F.col("c").alias("c_custkey"), F.col("o").alias("o_orderkey"), F.col("p").alias("l_partkey"), F.col("s").alias("s_suppkey"))


@query("SELECT c_name AS value FROM customer WHERE c_acctbal > 0")
def simple_exec(t: Tables) -> DataFrame:
    return S.exec_(t.q("customer", "c_custkey"), F.col("c_name"), constraints=[F.col("c_acctbal") > 0])


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 5000)")
def delete_many(t: Tables) -> DataFrame:
    return S.delete(t.q("customer", "c_custkey"), [F.col("c_acctbal") > 5000]).df.select("c_custkey")


@query("SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1")
def user_aggregate(t: Tables) -> DataFrame:
    """A function of the user's own over the values of a group."""

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return S.select(t.q("orders"), {"spread": F.round(spread("o_totalprice"), 2)}, {"o_orderpriority": F.col("o_orderpriority")}).df


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3 GROUP BY 1")
def view_recompute(t: Tables) -> DataFrame:
    """A view over a view, read again after its table was set."""
    v = Views()
    v.set("nation", t.nation)
    v.set("region", t.region)
    v.view("named", lambda n, r: n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), "nation", "region")
    v.view("counts", lambda x: x.groupBy("r_name").agg(F.count(F.lit(1)).alias("n")), "named")
    v.get("counts")
    v.set("nation", t.nation.where("n_nationkey > 3"))
    return v.get("counts")


# verbs
@query("SELECT event_id, product(1 + value / 1000) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) > 2 AS doubled FROM events")
def prds_running(t: Tables) -> DataFrame:
    o = Order(["ts"], ["user_id"])
    return t.events.withColumn("x", 1 + F.col("value") / 1000).select("event_id", (o.prds("x") > 2).alias("doubled"))


@query("SELECT n_nationkey, n_name = upper(n_name) AS same, false AS types, true AS nulls FROM nation")
def match_values(t: Tables) -> DataFrame:
    null = F.lit(None).cast("string")
    return t.nation.select("n_nationkey", V.match("n_name", F.upper("n_name")).alias("same"), V.match("n_nationkey", F.col("n_nationkey").cast("long")).alias("types"), V.match(null, null).alias("nulls"))


@query("SELECT n_nationkey, n_regionkey = 0 AS none, true AS near, false AS far FROM nation")
def not_and_tolerant(t: Tables) -> DataFrame:
    x = F.col("n_nationkey") + 0.1
    return t.nation.select("n_nationkey", semantics.negate_truth(F.col("n_regionkey")).alias("none"), semantics.tolerant_eq(x, x * (1 + 2.0**-50)).alias("near"), semantics.tolerant_eq(x, x * (1 + 2.0**-30)).alias("far"))


@query("SELECT o_orderkey, [(o_orderkey // 4096) % 16, (o_orderkey // 256) % 16, (o_orderkey // 16) % 16, o_orderkey % 16]::BIGINT[] AS digits, o_orderkey % 65536 AS back FROM orders")
def digits_in_base(t: Tables) -> DataFrame:
    d = V.to_digits(16, "o_orderkey", 4)
    return t.orders.select("o_orderkey", d.alias("digits"), V.from_digits(16, d).alias("back"))


@query("SELECT c_custkey, printf('%.2f', round(c_acctbal, 2)) AS money FROM customer")
def fixed_decimals(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.fmt(semantics.rounded("c_acctbal", 2), 2).alias("money"))


@query("SELECT count(*) AS n, true AS inside, true AS spread, true AS again, true AS distinct_ids, true AS shape FROM customer")
def seeded_choices(t: Tables) -> DataFrame:
    c = t.customer.select(V.roll(6, "c_custkey", 1).alias("r"), V.rand("c_custkey", 2).alias("x"), (V.roll(6, "c_custkey", 1) == V.roll(6, "c_custkey", 1)).alias("same"), V.guid("c_custkey").alias("g"))
    return c.agg(
        F.count(F.lit(1)).alias("n"),
        (F.bool_and(F.col("r").between(0, 5)) & F.bool_and((F.col("x") >= 0) & (F.col("x") < 1))).alias("inside"),
        (F.count_distinct("r") == 6).alias("spread"),
        F.bool_and("same").alias("again"),
        (F.count_distinct("g") == F.count(F.lit(1))).alias("distinct_ids"),
        F.bool_and(F.col("g").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("shape"),
    )


@query("SELECT true AS date_agrees, true AS in_day FROM region WHERE r_regionkey = 0")
def clocks(t: Tables) -> DataFrame:
    one = t.region.where("r_regionkey = 0")
    return one.select((V.clock("d") == V.clock("p").cast("date")).alias("date_agrees"), ((V.clock("t") >= 0) & (V.clock("t") < 86_400_000) & (V.clock("n") < 86_400_000_000)).alias("in_day"))


@query("SELECT n_nationkey, round(2.0 / (2 * (n_nationkey + 1) - 1), 9)::DOUBLE AS a, round((n_nationkey + 1.0) / (2 * (n_nationkey + 1) - 1), 9)::DOUBLE AS d FROM nation")
def matrix_inverse(t: Tables) -> DataFrame:
    """[[k+1, 1], [1, 2]] inverted: the corners."""
    m = F.array(F.array((F.col("n_nationkey") + 1).cast("double"), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))
    return t.nation.select("n_nationkey", N.inv(m).alias("i")).select("n_nationkey", F.round(F.col("i")[0][0], 9).alias("a"), F.round(F.col("i")[1][1], 9).alias("d"))


@query("SELECT n_nationkey, len(list_filter(range(0, n_regionkey + 3), lambda x: x % 2 = 1))::BIGINT AS odd, (n_regionkey + 3)::BIGINT AS n, list_concat(range(0, 2), range(0, n_regionkey::BIGINT))::BIGINT[] AS joined FROM nation")
def til_where_raze(t: Tables) -> DataFrame:
    n = F.col("n_regionkey") + 3
    odd = N.where_true(F.transform(N.til(n), lambda x: x % 2 == 1))
    return t.nation.select("n_nationkey", F.size(odd).cast("long").alias("odd"), F.size(N.til(n)).cast("long").alias("n"), N.raze(F.array(N.til(F.lit(2)), N.til(F.col("n_regionkey")))).cast("array<bigint>").alias("joined"))


@query("SELECT p_partkey, round(tan(p_retailprice / 10000), 9) AS t, round(asin(p_size / 100.0), 9) AS s, round(acos(p_size / 100.0), 9) AS c, round(atan(p_size), 9) AS a FROM part")
def trigonometry(t: Tables) -> DataFrame:
    f = lambda x, n: F.round(x, 9).alias(n)
    return t.part.select("p_partkey", f(F.tan(F.col("p_retailprice") / 10000), "t"), f(F.asin(F.col("p_size") / 100.0), "s"), f(F.acos(F.col("p_size") / 100.0), "c"), f(F.atan("p_size"), "a"))


# files and the provider
@query("SELECT n_name AS line FROM nation")
def lines_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "lines")
    files.save_text(t.nation.select(F.col("n_name").alias("value")), path)
    lines = files.read0(t.spark, path)
    return lines.select(F.col(lines.columns[0]).alias("line"))


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(t: Tables) -> DataFrame:
    """Types are inferred; whole numbers come back as wide as the column had them."""
    path = _folder(t, "inferred")
    files.write_csv(t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), path)
    back = files.read_csv(t.spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query("SELECT n_nationkey::INTEGER AS n_nationkey, n_name FROM nation")
def csv_to_columns(t: Tables) -> DataFrame:
    csv, path = _folder(t, "csv"), _folder(t, "columns")
    files.write_csv(t.nation.select("n_nationkey", "n_name"), csv)
    files.csv_to_splayed(t.spark, csv, path, "is")
    return files.get_splayed(t.spark, path)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def provider_pushdown(t: Tables) -> DataFrame:
    """A table of a DuckDB file, written by append, read back with the filters answered by the file."""
    provider.register(t.spark)
    path = _folder(t, "duck").removeprefix("file://") + ".duckdb"
    with duckdb.connect(path):
        pass
    provider.append(t.nation, path, "nation")
    rows = t.spark.read.format("duck").option("path", path).option("table", "nation").load()
    return rows.where((F.col("n_regionkey") == 2) & (F.col("n_nationkey") > 5)).select("n_nationkey", "n_name")


@query("SELECT r_regionkey, round(avg(n_nationkey), 6) AS mean FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def least_squares(t: Tables) -> DataFrame:
    """Regressing on a constant gives the mean."""
    g = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.col("n_nationkey").cast("double")).alias("y"))
    ones = F.array(F.transform("y", lambda _: F.lit(1.0)))
    return g.select("r_regionkey", F.round(N.lsq(F.array("y"), ones)[0][0], 6).alias("mean"))


