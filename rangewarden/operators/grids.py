"""AGG-9 to 13: traffic by /16, as a grid of first and second octets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import octet
from rangewarden.operators.prefixes import in_ranges


def grid(counts: DataFrame, *by: str) -> DataFrame:
    """AGG-9, 10: requests of each /16 that has any."""
    return counts.groupBy(*by, octet(F.col("ip"), 1).alias("o1"), octet(F.col("ip"), 2).alias("o2")).agg(F.sum("cnt").alias("n"))


def clustered_grid(counts: DataFrame, ranges: DataFrame, *by: str) -> DataFrame:
    """AGG-11: the grid of the requests that lie in a found range; by: columns of both, such as a set's."""
    return grid(in_ranges(counts, ranges.select(*by, "start", "len").distinct(), *by).select(*by, "ip", "cnt").distinct(), *by)


def blocks(cells: DataFrame, scale: int = 8, *by: str) -> DataFrame:
    """AGG-12."""
    return cells.groupBy(*by, F.expr(f"o1 div {scale}").alias("b1"), F.expr(f"o2 div {scale}").alias("b2")).agg(F.sum("n").alias("n"))


def intensity(cells: DataFrame, how: str = "linear") -> DataFrame:
    """AGG-13: each cell's share of the largest, linear, by root or by logarithm. There are 65,536 cells at most."""
    share = F.col("n") / F.max("n").over(Window.partitionBy())
    value: Column = {"linear": share, "sqrt": F.sqrt(share), "log": F.log1p(F.col("n")) / F.log1p(F.max("n").over(Window.partitionBy()))}[how]
    return cells.withColumn("intensity", value).withColumn("step", F.least(F.lit(10), F.ceil(F.col("intensity") * 10)).cast("int"))


def capture(cells: DataFrame, clustered: DataFrame, *by: str) -> DataFrame:
    """AGG-13: how much of each cell lies in found ranges: full from 0.8, part from 0.2, some above 0."""
    joined = cells.join(clustered.withColumnRenamed("n", "c"), [*by, "o1", "o2"], "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    ratio = F.col("c") / F.col("n")
    return joined.withColumn("ratio", ratio).withColumn("bucket", F.when(ratio >= 0.8, "full").when(ratio >= 0.2, "part").when(ratio > 0, "some").otherwise("none"))
