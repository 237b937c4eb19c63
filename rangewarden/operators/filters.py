"""FLT and JOIN-1: which requests count, and what is counted about those that don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import cidr_text
from rangewarden.functions.regexes import matches
from rangewarden.functions.times import within

def request_filter(user_agent_regex: str | None = None, endpoint_regex: str | None = None, start=None, end=None) -> Column | None:
    """FLT-1 to 4: time, then the user agent, then the endpoint; None if nothing is asked for."""
    out = None
    for one in (within(start, end), matches(F.col("user_agent"), user_agent_regex), matches(F.col("uri"), endpoint_regex)):
        if one is not None:
            out = one if out is None else out & one
    return out


def user_agent_list(spark: SparkSession, whitelist: list[str], blacklist: list[str]) -> DataFrame:
    """D7: trimmed, lowered entries with their verdict, 1 or -1; an entry of both lists is whitelisted."""
    verdict = {x.strip().lower(): -1 for x in blacklist if x.strip()} | {x.strip().lower(): 1 for x in whitelist if x.strip()}
    return spark.createDataFrame(sorted(verdict.items()), "ua_lc string, verdict int")


def with_verdict(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """JOIN-1: each request's verdict by its whole user agent, lowered but not trimmed; null if it isn't listed. Spark broadcasts a list whose known size is small."""
    return requests.withColumn("ua_lc", F.lower("user_agent")).join(agents, "ua_lc", "left").drop("ua_lc")


def counted(filtered: DataFrame, *by: str) -> DataFrame:
    """FLT-6 to 8 in one pass, in their order: invalid addresses, then whitelisted agents, then what stays. Blacklisted requests stay and are marked."""
    valid, white = F.col("ip") != 0, F.col("verdict").eqNullSafe(1)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return filtered.groupBy(*by).agg(
        n(~valid).alias("skipped_invalid_ips"), n(valid & white).alias("ua_whitelisted"), n(valid & F.col("verdict").eqNullSafe(-1)).alias("ua_blacklisted"),
        n(valid & ~white).alias("total_after_filter"), F.countDistinct(F.when(valid & ~white, F.col("ip"))).alias("unique_ips"),
    )


def kept(filtered: DataFrame) -> DataFrame:
    """What goes into the counts: valid addresses whose agent isn't whitelisted."""
    return filtered.where((F.col("ip") != 0) & ~F.col("verdict").eqNullSafe(1))


def listed_ranges(filtered: DataFrame, verdict: int) -> DataFrame:
    """AGG-15, SET-2, 3: the addresses of listed agents as /32 ranges."""
    return filtered.where((F.col("ip") != 0) & (F.col("verdict") == verdict)).select("ip").distinct().select(cidr_text(F.col("ip"), F.lit(32)).alias("cidr"))
