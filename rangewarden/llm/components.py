"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangewarden.llm._common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of the edges (a, b), two longs.

    Each round joins every node's larger neighbours to its smallest one, then its smaller ones, until
    every component is a star around its smallest node: rounds grow with the logarithm of the size. Both
    steps are a partial aggregate and an equi-join, whose hot keys AQE splits; nothing reaches the driver
    but a count. Loops and repeated edges don't matter; no edges give no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(least, "u")
        after = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct())
        # Stars: nobody has two smaller neighbours, and no smaller neighbour has one of its own.
        done = after.groupBy("u").count().where("count > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        drop_written(now)
        drop_written(large)
        now = after
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
