"""What larger tables showed: results beside DuckDB's on values that small tables lack, and what a verb gathers."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kolumna.functions import nested as N
from kolumna.plans import graph as G
from kolumna.plans import vector as V
from kolumna.queries import all_queries, all_sql
from kolumna.streaming import streams


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return duckdb.connect().execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")


def test_decimals_are_those_of_the_binary_value(spark, tmp_path):
    xs = [1.005, -1.005, -0.001, -0.0, 0.125, 2.675, 0.285, 1e23, 123456789012345.67, float("nan"), float("inf"), float("-inf"), None]
    xs += [k / 1000 for k in range(-3000, 3000, 5)]
    duck = written(spark, tmp_path, "customer", list(enumerate(xs)), "c_custkey long, c_acctbal double")
    got = {r["c_custkey"]: r["money"] for r in all_queries()["fixed_decimals"](spark, str(tmp_path)).collect()}
    assert got == dict(duck.execute(all_sql()["fixed_decimals"]).fetchall())


def test_streams_leave_their_rows_to_executors(spark, tmp_path):
    for part in range(3):
        rows = spark.range(part * 100, part * 100 + 150).select("id", F.timestamp_seconds(1_000_000_000 + F.col("id") % 7).alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = streams.event_time(streams.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in"))))
    once = streams.run_to_table(streams.deduplicated(df, "id").select("id"), "append")
    assert sorted(r["id"] for r in once.collect()) == list(range(350)) and len(once.inputFiles()) > 0
    total = streams.run_to_table(streams.latest(df, ["id"], "ts", "ts"))
    assert total.count() == 350 and len(total.inputFiles()) > 0
    nothing = streams.run_to_table(df.where("id < 0").select("id"), "append")
    assert nothing.columns == ["id"] and nothing.isEmpty()


def test_estimate_is_not_kept_for_every_distinct_value(spark):
    plan = all_queries()["approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keyed = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Aggregate [l_returnflag") and "l_partkey" in x.split("]")[0]]
    assert keyed and not any("approx_count_distinct" in x for x in keyed), plan


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 60_000])
def test_scan_of_long_lists(spark, n):
    df = spark.createDataFrame([(list(range(n)),), (None,)], "l array<int>")
    got = [r["s"] for r in df.select(N.scan(lambda a, x: a + x, F.lit(0), "l", "bigint").alias("s")).collect()]
    assert got == [[k * (k + 1) // 2 for k in range(n)], None]


def test_spanning_forest_by_rounds_and_by_folds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(a, b, float(rng.randrange(20))) for a, b in {tuple(sorted(rng.sample(range(200), 2))) for _ in range(900)}]
    df = spark.createDataFrame(rows, "src long, dst long, weight double").repartition(5)
    root, want = list(range(200)), set()
    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if root[a] != root[b]:
            want.add((a, b, w))
            root = [root[a] if x == root[b] else x for x in root]
    for local in (30, 1000):
        monkeypatch.setattr(G, "LOCAL", local)
        assert {(r["src"], r["dst"], r["weight"]) for r in G.mst(df).collect()} == want


def test_centrality_of_a_graph_of_many_edges(spark):
    star = spark.range(1, 2_000_100).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    source = spark.createDataFrame([(0,)], "node long")
    assert G.closeness(star, source).first()["closeness"] == 1.0
    assert G.betweenness(star, source).agg(F.max("betweenness"), F.count("node")).first()[:] == (0.0, 2_000_100)


def test_lightest_paths_of_a_graph_of_many_edges(spark):
    far = spark.range(100, 1_000_200).selectExpr("id AS src", "id + 1 AS dst", "1000D AS weight")
    near = spark.createDataFrame([(0, 1, 1.0), (1, 3, 1.0), (0, 2, 2.0), (2, 3, 2.0), (1, 2, 0.5), (3, 100, 1.0)], "src long, dst long, weight double")
    assert G.k_shortest(near.union(far), 0, 3, 3) == [(2.0, [0, 1, 3]), (3.5, [0, 1, 2, 3]), (4.0, [0, 2, 3])]


def test_hashed_search_in_blocks_is_the_join_by_patterns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries, s = df.where("vec_id % 50 = 0"), V.Signs(64, 2, 8)
    got = {(r["query"], r["vec_id"]) for r in s.search_many(None, df, "vec_id", "embedding", queries, 10).collect()}
    masks = [0, *(1 << i for i in range(8)), *((1 << i) | (1 << j) for i, j in itertools.combinations(range(8), 2))]
    own = s.build(queries, "vec_id", "embedding").select(F.col("vec_id").alias("query"), "table", "code")
    probe = own.select("query", "table", F.explode(F.array(*[F.col("code").bitwiseXOR(F.lit(m)) for m in masks])).alias("code"))
    pairs = probe.join(s.build(df, "vec_id", "embedding"), ["table", "code"]).select("query", "vec_id").distinct()
    want = {(r["query"], r["vec_id"]) for r in V.ranked(pairs, df, "vec_id", "embedding", queries, 10, "cosine").collect()}
    assert got == want
