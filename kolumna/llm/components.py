"""Connected components of an edge table, by alternating large-star and small-star steps until nothing changes.

Each step replaces neighbours by their smallest neighbour with combinable minima, so a node with very many neighbours
is never gathered in one task; joins back to such a node are ordinary shuffle joins that adaptive execution splits.
Edges stay in the shared folder between rounds. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import free, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)),
            F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF)),
        ).first()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Edges are undirected; loops, repeated edges and edges with a null end are ignored.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        )
        new = stored(small.distinct(), "edges")
        new_state = _state(new)
        free(now)
        now, done, state = new, new_state == state, new_state
        if done:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
