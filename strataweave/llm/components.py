"""Connected components of a graph given by its edges, without any node's whole neighbourhood in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .exact_dedup import join_groups


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b`` of one orderable type).

    The component is its smallest node. Large-star and small-star steps
    (Kiveris et al., "Connected components in MapReduce and beyond") alternate
    until no edge changes; each step is an aggregation and a join, its result is
    written. The neighbours of a node that very many share are not brought
    together: its smallest one is dealt out to them. Loops (a = b) keep single
    nodes. An empty table gives no rows. Rounds grow with the logarithm of the
    nodes; if ``most_rounds`` are not enough, that is an error.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "component-edges")
    before, n = None, edges.count()
    for _ in range(most_rounds):
        # large star: every larger neighbour of u goes to the smallest node around u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size")), "component-lowest")
        large = join_groups(both.where("v >= u"), lowest, "u", "size", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "component-edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
