"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """node, comp: of every node of the edges (a, b), the least node of its component.

    Each round every node points to its least neighbour, pointers are followed
    to their ends, and the edges are rewritten between those ends.  A component
    at least halves its nodes each round, so rounds grow with the logarithm of
    the longest chain, and a hub's edges are aggregated before they are joined.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("comp")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        points = cut(points)
        while True:
            ahead = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            further = cut(points.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            points = further.select("node", "to")
            if further.filter("moved").isEmpty():
                break
        ends = cut(ends.join(points.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        moved = edges.join(points.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(points.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = cut(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return ends
