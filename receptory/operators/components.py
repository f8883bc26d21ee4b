"""Connected components by rounds of joins, with lineage cut in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receptory.operators.keep import kept


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the least node that it reaches.

    Each round hooks every node to the least root among its neighbours' and
    halves the paths to the roots; rounds are logarithmic in path length.
    """
    pairs = links.where("a <> b")
    both = kept(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "m").alias("m"))
        # the least label seen by any member of a component moves its root, and so all of its members
        roots = hooked.groupBy(F.col("component").alias("root")).agg(F.min("m").alias("to"))
        moved = hooked.join(roots, F.col("component") == F.col("root")).select("node", F.col("component").alias("old"), F.least("m", "to").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = kept(moved.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
