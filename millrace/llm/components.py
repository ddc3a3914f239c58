"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node it is connected with.

    Large-star and small-star steps in turn: each node hangs its neighbours onto its smallest
    neighbour.  The number of rounds grows with the logarithm of the longest path.  Only minima
    are gathered per node, with map-side combining.  The links of one node are joined with its
    minimum in one task, which Spark does not split, since one side is an aggregate.
    """
    edges = common.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = common.save(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        stable = after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        common.discard(edges)
        edges = after
        if stable:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
