"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import cut


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs to (id, component): component is the smallest id that can be reached. Ids without edges have no row.

    Each step hangs every node's larger neighbours, then every node's smaller ones, on the smallest neighbour: the number of edges
    never grows, and a few steps (the logarithm of the longest path) turn each component into a star. Only minima are
    gathered per node; the joins back are plain equi-joins, which adaptive execution splits at a hub with many edges.
    """
    e = cut(_ordered(edges), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _ordered(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        e = cut(_ordered(hung.select("v", F.col("m").alias("u")).unionByName(hung.select(F.col("u").alias("v"), F.col("m").alias("u")))), "small-star")
        # stars: every node hangs on one other, and none of these hangs itself
        hangs = e.groupBy("u").agg(F.count("*").alias("n"))
        if hangs.filter("n > 1").isEmpty() and e.join(hangs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
