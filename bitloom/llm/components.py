"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.tables import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's greater (large) or lesser (small) neighbours, and in the latter case the node, to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links (u, v): the root is the least node that can be reached. Alternates large and small stars until nothing changes.

    Each round is written to the shared folder, so that lost executors cost one round at most, and the rounds before it are deleted.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "links")
    mark = None
    while True:
        after = written(_star(_star(now, True), False), "links")
        forget(now)
        now = after
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new
