"""Counts by address and by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import prefix_of


def address_counts(requests: DataFrame, *by: str) -> DataFrame:
    """AGG-2: requests per valid address; every count above builds on it. Partial sums travel, not requests."""
    return requests.where("ip <> 0").groupBy(*by, "ip").agg(F.count("*").alias("cnt"))


def prefix_counts(counts: DataFrame, min_depth: int, max_depth: int, *by: str) -> DataFrame:
    """AGG-1: for each depth and prefix its count and those of its halves l and r. The root's own count is 0.

    Addresses are first summed to the deepest prefix that matters, so the depths multiply as few rows as can be.
    """
    deepest = counts.groupBy(*by, prefix_of(F.col("ip"), max_depth).alias("p0")).agg(F.sum("cnt").alias("c"))
    every = deepest.select(*by, "p0", "c", F.explode(F.sequence(F.lit(min_depth), F.lit(max_depth))).alias("depth"))
    over = F.lit(max_depth) - F.col("depth")
    side = F.when(F.col("depth") < max_depth, F.pmod(F.call_function("shiftright", "p0", over - 1), F.lit(2)))
    zero = F.lit(0).cast("long")
    return every.groupBy(*by, "depth", F.call_function("shiftright", "p0", over).alias("prefix")).agg(
        F.sum(F.when(F.col("depth") == 0, zero).otherwise(F.col("c"))).alias("cnt"),
        F.sum(F.when(side == 0, F.col("c")).otherwise(zero)).alias("l"),
        F.sum(F.when(side == 1, F.col("c")).otherwise(zero)).alias("r"),
    )


def in_ranges(counts: DataFrame, ranges: DataFrame, *by: str) -> DataFrame:
    """JOIN-6: rows of counts with each of the ranges (start, len, ...) that holds their address.

    An equi-join on the length and the prefix: each address is looked up once for each length there is, 33 at most.
    """
    lengths = ranges.agg(F.collect_set("len")).scalar()
    keyed = counts.withColumn("len", F.explode(lengths)).withColumn("range_prefix", prefix_of(F.col("ip"), F.col("len")))
    return keyed.join(ranges.withColumn("range_prefix", prefix_of(F.col("start"), F.col("len"))), [*by, "len", "range_prefix"]).drop("range_prefix")


def range_counts(counts: DataFrame, ranges: DataFrame, *by: str) -> DataFrame:
    """AGG-5: requests in each of the ranges (start, len), 0 included."""
    keys = [*by, "start", "len"]
    unique = ranges.select(*keys).distinct()
    return unique.join(in_ranges(counts, unique, *by).groupBy(*keys).agg(F.sum("cnt").alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def percent(part, total):
    """AGG-7."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def stats(requests: DataFrame, *by: str) -> DataFrame:
    """AGG-3, 4, 8, in one pass: invalid rows, those kept, and distinct addresses."""
    kept = F.col("ip") != 0
    return requests.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~kept, 1).otherwise(0)), F.lit(0)).cast("long").alias("skipped_invalid_ips"),
        F.coalesce(F.sum(F.when(kept, 1).otherwise(0)), F.lit(0)).cast("long").alias("total_requests"),
        F.countDistinct(F.when(kept, F.col("ip"))).alias("unique_ips"),
    )


def top_talkers(counts: DataFrame, n: int) -> DataFrame:
    """TOP-1: the n addresses of most requests, of equal ones the lower address; none for n <= 0."""
    return counts.orderBy(F.desc("cnt"), "ip").limit(max(0, n))
