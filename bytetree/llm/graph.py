"""Connected components of an edge table by alternating large-star and small-star contraction (Kiveris et al., 2014).

Neighbour minima are aggregates with map-side combination, and each is joined back on the node: no neighbour list is ever
gathered in one row, and adaptive execution can split the joins at hub nodes. Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges -> (node, root): root is the smallest node reachable. Nodes without an edge do not appear.

    Self loops, nulls and repeated edges are ignored. Rounds grow with the logarithm of the longest chain.
    """
    edges = cut(edges.select("u", "v").filter("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(small.distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
