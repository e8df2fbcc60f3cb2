"""Connected components of a link table by alternating stars.

In each round every node's links are bent to the smallest node it sees, first from larger neighbours, then from smaller
ones, until nothing changes. Only minima travel, never a node's list of neighbours, and each round's links are written
before the next, so a hub is no more than many rows of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import settle


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` ``(a, b)``: the smallest node that it is connected to."""
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # larger neighbours move to the least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # smaller neighbours, and the node itself, move to the least one
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = settle(small.where("u <> v").distinct())
        # stars, once every node has one link and no centre has one
        done = not new.groupBy("u").count().where("count > 1").take(1) and not new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").take(1)
        edges = new
        if done:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
