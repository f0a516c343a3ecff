"""Connected components by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the smallest node of its component.

    A round maps every node to its smallest neighbour (itself if smaller) and that one's, then keeps the
    edges between different images, so the graph shrinks geometrically.  A hot node is one row a task after
    partial aggregation, and a skewed left side of the joins, which adaptive execution splits.
    """
    edges = cut(edges.filter("a <> b").distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")))
        far = up.select(F.col("node").alias("p"), F.col("p").alias("far"))
        up = cut(up.join(far.hint("merge"), "p", "left").select("node", F.coalesce("far", "p").alias("p")))
        maps.append(up)
        left, right = up.withColumnsRenamed({"node": "a", "p": "pa"}), up.withColumnsRenamed({"node": "b", "p": "pb"})
        edges = edges.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        edges = cut(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a <> b").distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[0].withColumnRenamed("p", "root")
    for up in maps[1:]:
        up = up.withColumnsRenamed({"node": "root", "p": "next"})
        roots = roots.join(up.hint("merge"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots
