"""Connected components of an edge table, by alternating star contractions.

Each round points the larger neighbours of every node (large star) and then
the smaller ones (small star) at the smallest neighbour.  It ends after
O(log^2 n) rounds, whatever the diameter, with one star per component.  Only
counts and a checksum reach the driver; each round is written to the shared
scratch folder.  A node with very many edges is aggregated in the map tasks
and its join is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackyard.llm.common import merged, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return merged(turned, least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = merged(edges, least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)``; root is the smallest node reachable.

    Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    edges = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("u"),
                                                F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(edges)
    while True:
        edges = saved(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
