"""Queries for sources, streams, graphs, Datalog and vectors."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.plans import graph as G
from kolumna.plans import vector as V
from kolumna.plans.datalog import Entities, Program
from kolumna.queries.registry import Tables, query
from kolumna.session import shared_folder
from kolumna.sources import files
from kolumna.streaming import streams


def _folder(t: Tables, name: str) -> str:
    """A new path in the folder that executors share."""
    return f"{shared_folder(t.spark)}/kolumna-{name}-{os.urandom(6).hex()}"


# sources and sinks
@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "csv")
    files.write_csv(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return files.read_csv(t.spark, path, "js f", names=["c_custkey", "c_name", "c_nationkey", "c_acctbal"])


@query("SELECT n_nationkey, n_name FROM nation")
def fixed_width_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "fixed")
    lines = t.nation.select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 6, " "), F.rpad("n_name", 30, " ")).alias("value"))
    files.save_text(lines, path)
    return files.read_fixed(t.spark, path, "is", [6, 30], ["n_nationkey", "n_name"])


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def parted_pruning(t: Tables) -> DataFrame:
    path = _folder(t, "parted")
    files.save_parted(t.orders, path, "o_orderstatus", sort=["o_orderkey"])
    kept = files.get_splayed(t.spark, path).where("o_orderstatus = 'F'")
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT s_suppkey, s_name FROM supplier")
def json_file_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "json")
    files.save(t.supplier.select("s_suppkey", "s_name"), path, "json")
    return t.spark.read.schema("s_suppkey bigint, s_name string").json(path)


@query("SELECT r_regionkey, r_name FROM region")
def splayed_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "splay")
    files.save_splayed(t.region, path)
    return files.get_splayed(t.spark, path)


# streams
def _events_stream(t: Tables) -> DataFrame:
    return streams.event_time(streams.source(t.spark, t.folder, t.events, glob="events.parquet"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    w = streams.tumbling(_events_stream(t), "ts", "1 day", ["event_type"], n=F.count(F.lit(1)), v=F.sum("value"))
    out = streams.run_to_table(w)
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("v", 2).alias("v"))


@query(
    "WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts)]) AS s FROM events) SELECT epoch_us(s) AS start, count(*) AS n FROM w GROUP BY 1"
)
def stream_sliding(t: Tables) -> DataFrame:
    w = streams.sliding(_events_stream(t), "ts", "12 hours", "6 hours", [], n=F.count(F.lit(1)))
    return streams.run_to_table(w).select(F.unix_micros("start").alias("start"), "n")


@query(
    "WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS s FROM events),"
    " g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, k"
)
def stream_sessions(t: Tables) -> DataFrame:
    w = streams.sessions(_events_stream(t), "ts", "12 hours", ["user_id"], n=F.count(F.lit(1)))
    return streams.run_to_table(w).select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY 1")
def stream_latest(t: Tables) -> DataFrame:
    return streams.run_to_table(streams.latest(_events_stream(t), ["user_id"], "ts", "event_type", "value"))


@query("SELECT event_id FROM events")
def stream_deduplicated(t: Tables) -> DataFrame:
    once = streams.deduplicated(_events_stream(t), "event_id").select("event_id")
    return streams.run_to_table(once, "append")


# graphs over whole tables: regions, nations and customers (a forest); parts and their suppliers as one set of numbers
EDGES = "(SELECT DISTINCT (c_nationkey + 100)::BIGINT AS src, c_custkey + 1000 AS dst FROM customer UNION SELECT DISTINCT n_regionkey::BIGINT, (n_nationkey + 100)::BIGINT FROM nation)"


def _edges(t: Tables) -> DataFrame:
    low = t.customer.select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + 1000).alias("dst"))
    high = t.nation.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    return low.unionByName(high).distinct()


MESH = "(SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)"


def _mesh(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).where("src <> dst").distinct()


def _weighted(e: DataFrame) -> DataFrame:
    return e.withColumn("weight", ((F.col("src") * 7919 + F.col("dst") * 104729) % 1009 + 1).cast("double"))


#: All pairs of EDGES with the number of hops between them.
HOPS = f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(s, t, d) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT r.s, e.dst, d + 1 FROM r JOIN e ON e.src = r.t), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


@query(f"SELECT src, dst FROM {EDGES} WHERE src IN (0, 1)")
def graph_expand(t: Tables) -> DataFrame:
    return G.expand(_edges(t), t.spark.createDataFrame([(0,), (1,)], "node long"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(dst, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.dst WHERE depth < 3) SELECT 0::BIGINT AS src, dst, min(depth) AS depth FROM r WHERE depth >= 1 GROUP BY 2")
def graph_var_expand(t: Tables) -> DataFrame:
    return G.var_expand(_edges(t), t.spark.createDataFrame([(0,)], "node long"), 1, 3)


@query(
    f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, c) AS (SELECT src, src FROM b UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node)"
    " SELECT node, min(c) AS component FROM r GROUP BY 1"
)
def graph_components(t: Tables) -> DataFrame:
    return G.connected(_edges(t))


@query(f"WITH e AS (SELECT * FROM {MESH}) SELECT node, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(o, 0) + coalesce(i, 0) AS degree FROM (SELECT src AS node, count(*) AS o FROM e GROUP BY 1) FULL JOIN (SELECT dst AS node, count(*) AS i FROM e GROUP BY 1) USING (node)")
def graph_degree(t: Tables) -> DataFrame:
    return G.degree(_mesh(t))


def _rank_sql(rounds: int) -> str:
    """The iteration written out, round by round."""
    own = f"WITH e AS (SELECT * FROM {MESH}), v AS (SELECT node, o.n AS out FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN (SELECT src AS node, count(*) AS n FROM e GROUP BY 1) o USING (node)), r0 AS (SELECT node, out, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"
    for k in range(rounds):
        own += (
            f", g{k} AS (SELECT e.dst AS node, sum(rank / out) AS got FROM e JOIN r{k} ON e.src = r{k}.node GROUP BY 1), l{k} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{k} WHERE out IS NULL),"
            f" r{k + 1} AS (SELECT v.node, v.out, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(got, 0) + loose / (SELECT count(*) FROM v)) AS rank FROM v LEFT JOIN g{k} USING (node), l{k})"
        )
    return f"{own} SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query(_rank_sql(10))
def graph_pagerank(t: Tables) -> DataFrame:
    return G.pagerank(_mesh(t), rounds=10).select("node", F.round("rank", 9).alias("rank"))


@query(f"WITH u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {MESH}) SELECT x.a AS x, x.b AS y, y.b AS z FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def graph_triangles(t: Tables) -> DataFrame:
    from kolumna.operators.joins import wco_triangles

    return wco_triangles(_mesh(t))


@query(f"WITH RECURSIVE e AS (SELECT src, dst, ((src * 7 + dst * 3) % 11 + 1)::DOUBLE AS w FROM {EDGES}), r(node, d) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT e.dst, r.d + e.w FROM r JOIN e ON e.src = r.node) SELECT node, min(d) AS dist FROM r GROUP BY 1")
def graph_dijkstra(t: Tables) -> DataFrame:
    e = _edges(t).withColumn("weight", ((F.col("src") * 7 + F.col("dst") * 3) % 11 + 1).cast("double"))
    return G.dijkstra(e, 0).select("node", "dist")


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(node, k) AS (SELECT src, 0 FROM e UNION SELECT e.dst, k + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(k) AS level FROM r GROUP BY 1")
def graph_topsort(t: Tables) -> DataFrame:
    return G.topsort(_edges(t))


@query(
    f"WITH u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {MESH}), d AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY 1),"
    " t AS (SELECT unnest([x.a, x.b, y.b]) AS node FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), c AS (SELECT node, count(*) AS t FROM t GROUP BY 1)"
    " SELECT node, CASE WHEN d > 1 THEN round(2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)), 9) ELSE 0.0 END AS coefficient FROM d LEFT JOIN c USING (node)"
)
def graph_clustering(t: Tables) -> DataFrame:
    return G.clustering(_mesh(t)).select("node", F.round("coefficient", 9).alias("coefficient"))


@query(f"{HOPS}, i AS (SELECT t AS node, count(*) AS i FROM r GROUP BY 1), o AS (SELECT s AS node, count(*) AS o FROM r GROUP BY 1) SELECT node, (coalesce(i, 0) * coalesce(o, 0))::DOUBLE AS betweenness FROM n LEFT JOIN i USING (node) LEFT JOIN o USING (node)")
def graph_betweenness(t: Tables) -> DataFrame:
    """In a forest every pair above and below a node has its one path through it."""
    return G.betweenness(_edges(t))


@query(f"{HOPS}, o AS (SELECT s AS node, count(*) / sum(d) AS c FROM r GROUP BY 1) SELECT node, round(coalesce(c, 0), 9) AS closeness FROM n LEFT JOIN o USING (node)")
def graph_closeness(t: Tables) -> DataFrame:
    return G.closeness(_edges(t)).select("node", F.round("closeness", 9).alias("closeness"))


@query()
def graph_mst(t: Tables) -> DataFrame:
    """The spanning forest's edges; a test compares them with Kruskal's on a small graph."""
    return G.mst(_weighted(_mesh(t)))


@query()
def graph_communities(t: Tables) -> DataFrame:
    return G.label_communities(_mesh(t), rounds=4)


@query()
def graph_random_walk(t: Tables) -> DataFrame:
    """Walks from every supplier along parts and suppliers, in either direction."""
    return G.random_walk(G.undirected(_mesh(t)), t.supplier.select(F.col("s_suppkey").alias("node")), 5)


@query(
    f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(node, depth, parent, path) AS (SELECT 0::BIGINT, 0::BIGINT, NULL::BIGINT, [0::BIGINT] UNION ALL SELECT e.dst, depth + 1, r.node, list_append(path, e.dst) FROM r JOIN e ON e.src = r.node)"
    " SELECT node, row_number() OVER (ORDER BY path) - 1 AS ord, depth, parent FROM r"
)
def graph_dfs(t: Tables) -> DataFrame:
    return G.dfs(_edges(t), 0)


@query()
def graph_k_shortest(t: Tables) -> DataFrame:
    """The five lightest paths from the last part to supplier 1; a test compares them with all paths of a small graph."""
    source = t.lineitem.agg(F.max("l_partkey")).first()[0]
    paths = G.k_shortest(_weighted(G.undirected(_mesh(t))), source, 1, 5)
    return t.spark.createDataFrame([(i, d, "-".join(map(str, p))) for i, (d, p) in enumerate(paths)], "n int, dist double, path string")


@query(f"WITH RECURSIVE e AS (SELECT src, dst, ((src * 7919 + dst * 104729) % 1009 + 1)::DOUBLE AS w FROM {EDGES}), r(node, d) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT e.dst, r.d + e.w FROM r JOIN e ON e.src = r.node) SELECT max(d) AS dist, 2::BIGINT AS hops FROM r WHERE node = (SELECT min(dst) FROM e WHERE src IN (SELECT dst FROM e WHERE src = 0))")
def graph_astar(t: Tables) -> DataFrame:
    """From a region to its first customer, by way of the nation."""
    e = G.cut(_weighted(_edges(t)))
    goal = e.join(e.where("src = 0").select(F.col("dst").alias("src")), "src").agg(F.min("dst")).first()[0]
    dist, path = G.astar(e, 0, goal, lambda node: F.lit(0.0))
    return t.spark.createDataFrame([(dist, len(path) - 1)], "dist double, hops long")


@query(f"SELECT src, count(*) AS n FROM {EDGES} WHERE src BETWEEN 100 AND 199 GROUP BY 1")
def graph_expand_counts(t: Tables) -> DataFrame:
    return G.expand_counts(_edges(t), t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("node")))


@query(f"WITH e AS (SELECT * FROM {EDGES}) SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY src)) AS widest")
def graph_info(t: Tables) -> DataFrame:
    return G.info(_edges(t))


# Datalog
@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src AS x, dst AS y FROM r")
def datalog_closure(t: Tables) -> DataFrame:
    p = Program(t.spark).add("edge", _edges(t))
    p.rule(("path", ("?x", "?y")), ("edge", ("?x", "?y")))
    p.rule(("path", ("?x", "?z")), ("path", ("?x", "?y")), ("edge", ("?y", "?z")))
    return p.query(["?x", "?y"], ("path", ("?x", "?y")))


@query(f"WITH e AS (SELECT * FROM {EDGES}) SELECT DISTINCT dst AS x FROM e WHERE dst NOT IN (SELECT src FROM e) AND dst > 1100")
def datalog_negation(t: Tables) -> DataFrame:
    p = Program(t.spark).add("edge", _edges(t))
    p.rule(("inner", ("?x",)), ("edge", ("?x", "?y")))
    p.rule(("leaf", ("?x",)), ("edge", ("?y", "?x")), ("not", ("inner", ("?x",))), (">", "?x", 1100))
    return p.query(["?x"], ("leaf", ("?x",)))


@query("SELECT n_nationkey::BIGINT AS e, n_name AS name, n_regionkey::VARCHAR AS region FROM nation WHERE n_nationkey <> 3")
def entity_pull(t: Tables) -> DataFrame:
    n = t.nation
    e = F.col("n_nationkey").cast("long").alias("e")
    facts = n.select(e, F.lit("name").alias("a"), F.col("n_name").alias("v")).union(n.select(e, F.lit("region"), F.col("n_regionkey").cast("string")))
    db = Entities(facts)
    return db.retract(db.df.where("e = 3")).pull("name", "region")


# vectors
QUERY = [0.1 * ((i * 7) % 11) - 0.5 for i in range(64)]
QSQL = "[" + ", ".join(f"{x:.17g}" for x in QUERY) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {QSQL}), 9) AS dist FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {QSQL}), vec_id LIMIT 10")
def knn_cosine(t: Tables) -> DataFrame:
    return V.knn(t.embeddings, "vec_id", "embedding", QUERY, 10).select("vec_id", F.round("dist", 9).alias("dist"))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {QSQL}), 9) AS dist FROM embeddings WHERE label < 5 ORDER BY list_distance(embedding::DOUBLE[], {QSQL}), vec_id LIMIT 10")
def knn_filtered_l2(t: Tables) -> DataFrame:
    return V.nearest(t.embeddings, F.col("label") < 5, "vec_id", "embedding", QUERY, 10, "l2").select("vec_id", F.round("dist", 9).alias("dist"))


@query(f"SELECT vec_id, round(-list_inner_product(embedding::DOUBLE[], {QSQL}), 9) AS dist FROM embeddings ORDER BY -list_inner_product(embedding::DOUBLE[], {QSQL}), vec_id LIMIT 10")
def knn_inner_product(t: Tables) -> DataFrame:
    return V.knn(t.embeddings, "vec_id", "embedding", QUERY, 10, "ip").select("vec_id", F.round("dist", 9).alias("dist"))


@query()
def ann_hashed(t: Tables) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 50, among all rows; a test measures recall against knn."""
    s = V.Signs(64)
    index = s.build(t.embeddings, "vec_id", "embedding")
    return s.search_many(index, t.embeddings, "vec_id", "embedding", t.embeddings.where("vec_id % 50 = 0"), 10)


@query("WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 50 = 0) SELECT query, vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS dist FROM q, embeddings QUALIFY row_number() OVER (PARTITION BY query ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), vec_id) <= 10")
def knn_many(t: Tables) -> DataFrame:
    found = V.knn_many(t.embeddings, "vec_id", "embedding", t.embeddings.where("vec_id % 50 = 0"), 10)
    return found.select("query", "vec_id", F.round("dist", 6).alias("dist"))
