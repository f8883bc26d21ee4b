"""Connected components of an edge table by rounds of joins; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receptory.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), long; the component is its least node.

    Alternates large-star and small-star steps, which keep connectivity and
    the number of edges and need a logarithmic number of rounds; each round is
    written to the shared folder, so lost executors cost one round at most.
    A node's least neighbour is aggregated before the join, so hubs are not
    gathered in one task.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.select("a", F.col("m").alias("b"))).distinct()
        small = stored(small, "small")
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        discard(edges, large)
        edges = small
        if not changed:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
