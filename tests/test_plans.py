"""Plans (what reaches the scan, what is gathered) and verbs without SQL, against brute force on small data."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kolumna.operators import joins as J
from kolumna.operators import select as S
from kolumna.operators import sort
from kolumna.operators.views import Views
from kolumna.operators.window import Order, ema
from kolumna.plans import graph as G
from kolumna.plans import vector as V
from kolumna.qtable import QTable, numbered

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def pushed(df):
    return [line.split("PushedFilters:")[1].split("]")[0] for line in plan(df).splitlines() if "PushedFilters:" in line]


def test_filters_reach_the_scan(spark):
    t = QTable(spark.read.parquet(f"{FOLDER}/lineitem.parquet"))
    kept = S.select(t, {"n": F.count(F.lit(1))}, {"k": F.col("l_returnflag")}, [F.col("l_quantity") > 25]).df
    gone = S.delete(t, [F.col("l_quantity") > 25]).df
    for df in (kept, gone):
        assert any("l_quantity" in x for x in pushed(df)), plan(df)


def test_delete_keeps_rows_where_the_constraint_is_unknown(spark):
    t = QTable(spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "k int, x double"))
    assert sorted(r["k"] for r in S.delete(t, [F.col("x") > 25]).df.collect()) == [1, 2]
    assert sorted(r["k"] for r in S.delete(t, [F.col("x") > 1, F.col("k") > 1]).df.collect()) == [1, 2]
    assert S.delete(t).df.isEmpty()


def test_update_by_folds_passing_rows_and_joins_them_back(spark):
    rows = [(k, g, x) for k, (g, x) in enumerate(itertools.product(["a", None, "b"], [1.0, 2.0, None, 9.0]))]
    t = QTable(spark.createDataFrame(rows, "k int, g string, x double"), order=("k",))
    out = S.update(t, {"x": F.max("x"), "y": F.count(F.lit(1))}, ["g"], [F.col("x") < 5]).df
    assert out.columns == ["k", "g", "x", "y"] and "Window" not in plan(out)
    got = {r["k"]: (r["x"], r["y"]) for r in out.collect()}
    assert got == {k: (2.0, 2) if x is not None and x < 5 else (x, None) for k, _, x in rows}


def test_row_numbers_hold_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = spark.range(0, 50_000, 1, 40).select(F.xxhash64("id").alias("k"), "id")
    got = numbered(QTable(rows, order=("k", "id")), "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(50_000))
    assert all(a["k"] <= b["k"] for a, b in zip(got, got[1:]))
    assert numbered(QTable(rows.limit(0), order=("id",))).isEmpty()


def test_grades_and_sorts_agree_with_python(spark):
    rng = random.Random(1)
    xs = [rng.choice([None, *range(20)]) for _ in range(300)]
    t = QTable(spark.createDataFrame(list(enumerate(xs)), "k int, x int").repartition(8), order=("k",))
    least = lambda x: -1 if x is None else x
    up, down = sorted(range(300), key=lambda i: (least(xs[i]), i)), sorted(range(300), key=lambda i: (-least(xs[i]), i))
    for f, want in ((sort.iasc, up), (sort.idesc, down)):
        assert [r["row"] for r in f(t, "x").orderBy("position").collect()] == want
    assert [r["k"] for r in sort.xasc(t, "x").collect()] == up and [r["k"] for r in sort.xdesc(t, "x").collect()] == down


def test_asof_without_equal_keys_agrees_with_brute_force(spark):
    rng = random.Random(3)
    quotes = sorted((rng.randrange(5000), i) for i in range(800))
    x = QTable(spark.createDataFrame([(i, rng.randrange(-50, 5200)) for i in range(900)], "i int, t int").repartition(6), order=("i",))
    y = QTable(spark.createDataFrame(quotes, "t int, q int").repartition(6), order=("q",))
    df, _ = J.asof_rows(x, y, ["t"])
    want = {}
    for r in x.df.collect():
        before = [q for t, q in quotes if t <= r["t"]]
        want[r["i"]] = quotes[len(before) - 1][1] if before else None
    assert {r["i"]: r["__m"] and r["__m"]["q"] for r in df.collect()} == want


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_moving_average_does_not_depend_on_its_blocks(spark, by, block):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", None]), rng.choice([None, 1.0, 5.0, -3.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, g string, x double").repartition(4)
    got = {r["i"]: r["ema"] for r in ema(df, Order(["i"], by), 0.3, "x", block=block).collect()}
    last = {}
    for i, g, x in rows:
        key = g if by else 0
        last[key] = (x or 0.0) if key not in last else 0.3 * (x or 0.0) + 0.7 * last[key]
        assert got[i] == pytest.approx(last[key])


def random_graph(seed, n=14, m=40):
    rng = random.Random(seed)
    return sorted({(a, b): rng.randrange(1, 50) + 0.0 for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}.items())


def test_spanning_forest_is_kruskals(spark):
    edges = [(a, b, w * 1000 + i) for i, ((a, b), w) in enumerate(random_graph(5))] + [(100, 101, 3.0)]
    got = {(r["src"], r["dst"], r["weight"]) for r in G.mst(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    root, want = {}, set()

    def top(v):
        while root.get(v, v) != v:
            v = root[v]
        return v

    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.add((min(a, b), max(a, b), w))
    assert got == want


def all_paths(edges, source, target):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
    out, stack = [], [(0.0, [source])]
    while stack:
        d, p = stack.pop()
        if p[-1] == target:
            out.append((d, p))
            continue
        stack += [(d + w, [*p, b]) for b, w in near.get(p[-1], {}).items() if b not in p]
    return sorted(out)


def test_lightest_paths_are_those_of_all_paths(spark):
    edges = [(a, b, w + i / 1000) for i, ((a, b), w) in enumerate(random_graph(9, 8, 24))]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    want = all_paths(edges, 0, 7)[:4]
    got = G.k_shortest(df, 0, 7, 4)
    assert [p for _, p in got] == [p for _, p in want] and all(math.isclose(a, b) for (a, _), (b, _) in zip(got, want))
    dist, path = G.astar(df, 0, 7, lambda node: F.lit(0.0))
    assert path == want[0][1] and math.isclose(dist, want[0][0])
    assert G.astar(df, 0, 99, lambda node: F.lit(0.0)) == (math.inf, [])


def test_centrality_agrees_with_enumeration(spark):
    edges = [(a, b, 1.0) for (a, b), _ in random_graph(4, 7, 14)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    between, close = dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        hops = []
        for t in nodes:
            if s != t and (paths := all_paths(edges, s, t)):
                short = [p for d, p in paths if d == paths[0][0]]
                hops.append(paths[0][0])
                for p in short:
                    for v in p[1:-1]:
                        between[v] += 1 / len(short)
        close[s] = len(hops) / sum(hops) if hops else 0.0
    assert {r["node"]: pytest.approx(r["betweenness"]) for r in G.betweenness(df).collect()} == between
    assert {r["node"]: pytest.approx(r["closeness"]) for r in G.closeness(df).collect()} == close


def test_communities_part_two_cliques(spark):
    cliques = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 5), 2)] + [(4, 10)]
    got = {r["node"]: r["community"] for r in G.label_communities(spark.createDataFrame(cliques, "src long, dst long"), 8).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


def test_random_walks_follow_edges_and_repeat(spark):
    edges = {(a, b) for (a, b), _ in random_graph(6)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    start = spark.createDataFrame([(0,), (3,)], "node long")
    one, two = ({(r["walk"], r["step"]): r["node"] for r in G.random_walk(df, start, 6).collect()} for _ in range(2))
    assert one == two and len(one) == 14
    for (w, k), node in one.items():
        if k:
            before = one[w, k - 1]
            assert (before, node) in edges or (node == before and not any(a == before for a, _ in edges))


def test_hashed_search_finds_nine_tenths(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = df.where("vec_id % 50 = 0")
    s = V.Signs(64)
    found = s.search_many(s.build(df, "vec_id", "embedding"), df, "vec_id", "embedding", queries, 10)
    exact = V.knn_many(df, "vec_id", "embedding", queries, 10)
    rows = {(r["query"], r["vec_id"]) for r in exact.collect()}
    hit = {(r["query"], r["vec_id"]) for r in found.collect()}
    assert len(rows) == 10 * queries.count() and len(rows & hit) >= 0.9 * len(rows)
    one = queries.first()
    near = {r["vec_id"] for r in V.knn(df, "vec_id", "embedding", [float(x) for x in one["embedding"]], 10).collect()}
    assert near == {v for q, v in rows if q == one["vec_id"]}


def test_multiway_pattern_is_the_brute_force_one(spark):
    rng = random.Random(7)
    r, s, u = ([(rng.randrange(6), rng.randrange(6)) for _ in range(20)] for _ in range(3))
    frame = lambda x: spark.createDataFrame(x, "a int, b int")
    got = {tuple(x[v] for v in "xyz") for x in J.multiway((frame(r), "xy"), (frame(s), "yz"), (frame(u), "zx")).collect()}
    assert got == {(x, y, z) for x, y in r for y2, z in s for z2, x2 in u if (y, z, x) == (y2, z2, x2)}
    loops = {x["x"] for x in J.multiway((frame(r), "xx")).collect()}
    assert loops == {a for a, b in r if a == b}
    with pytest.raises(ValueError):
        J.multiway((frame(r), "xy"), (frame(s), "zw"))


def test_insert_refuses_a_key_that_is_there(spark):
    t = QTable(spark.createDataFrame([(1, "a")], "k int, v string"), ("k",))
    assert J.insert(t, spark.createDataFrame([(2, "b")], "k int, v string")).df.count() == 2
    with pytest.raises(ValueError):
        J.insert(t, spark.createDataFrame([(1, "b")], "k int, v string"))


def test_views_follow_their_tables(spark):
    v = Views()
    v.set("a", spark.range(3))
    v.view("b", lambda a: a.where("id > 0"), "a")
    v.view("c", lambda b: b.agg(F.sum("id").alias("s")), "b")
    assert v.get("c").first()["s"] == 3 and (v.tables(), v.views()) == (["a"], ["b", "c"])
    v.set("a", spark.range(5))
    assert v.get("c").first()["s"] == 10
    with pytest.raises(ValueError):
        v.view("a", lambda c: c, "c")


def test_provider_answers_filters_and_appends(spark, tmp_path):
    import duckdb

    from kolumna.sources import provider

    provider.register(spark)
    path = str(tmp_path / "x.duckdb")
    duckdb.connect(path).close()
    rows = spark.range(1000).select("id", (F.col("id") % 7).cast("int").alias("m"), F.concat(F.lit("s"), "id").alias("s"))
    provider.append(rows, path, "x")
    provider.append(rows.where("id < 10"), path, "x")
    assert provider.count(path, "x") == 1010 and [c for c, _ in provider.meta(path, "x")] == ["id", "m", "s"]
    df = spark.read.format("duck").option("path", path).option("table", "x").load()
    some = df.where("m = 3 and id >= 500 and s is not null and length(s) > 3")
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(500, 1000) if i % 7 == 3]
    assert df.where("m in (1, 2) and id < 20").count() == len([i for i in range(20) if i % 7 in (1, 2)]) + len([i for i in range(10) if i % 7 in (1, 2)])
