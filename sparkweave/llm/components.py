"""Connected components of a link table by alternating star steps, as joins and aggregations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the smallest node that links reach) of every node of links (a, b: long). Nulls and loops are left out.

    Each round links every neighbour of a node that is larger than the node to the node's smallest neighbour (large
    star), then all smaller neighbours to the smallest (small star). The links end as stars around the roots; the
    number of rounds grows with the logarithm of the longest path. Rounds are written to the shared folder.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch.put(now, f"{name}-0")
    mark, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        step += 1
        following = scratch.put(small.where("a <> b").distinct(), f"{name}-{step}")
        found = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        now = following
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
