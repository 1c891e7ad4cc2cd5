"""Connected components by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node that can be reached, for every node of an edge.

    Distributed union-find: a node takes the smallest label among its own, its neighbours' and that of its label's own label, until
    nothing changes. Labels are written after each round; the rounds grow with the logarithm of the longest chain.
    """
    both = edges.where("a <> b")
    both = common.saved(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("jumped"))
        new = common.saved(low.join(jump, "root", "left").select("node", "was", F.least("root", "jumped").alias("root")))
        labels = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return labels
