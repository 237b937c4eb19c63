"""STR-5, AGG-16: first-in first-out windows with a bound on age and one on size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A bound on size from here on is none: no window can hold so many rows.
UNBOUNDED = 1 << 31


def survivors(rows: DataFrame, cutoff: Column, max_size: int, *by: str) -> DataFrame:
    """Rows (ts, arrival) left in a queue: old ones leave from its head up to the first that is young enough, then the earliest arrivals beyond max_size.

    A young row shields older ones that arrived after it. Apply it to the last survivors with each batch;
    over a whole history it differs, as the size can push out a row that shielded others.
    """
    young = F.min(F.when(F.col("ts") >= cutoff, F.col("arrival")))
    if by:
        first = rows.groupBy(*by).agg(young.alias("first"))
        rows = rows.join(first, list(by)).where("arrival >= first").drop("first")
        return rows.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("arrival")))).where(F.col("back") <= max_size).drop("back")
    rows = rows.where(F.col("arrival") >= rows.agg(young).scalar())
    # The latest arrivals of each task, then those of all: no task gets more than the bound from each.
    return rows if max_size >= UNBOUNDED else rows.orderBy(F.desc("arrival")).limit(max_size)


def address_stats(rows: DataFrame, *by: str) -> DataFrame:
    """AGG-16: for each address its requests in the window and the time of the latest arrival."""
    return rows.groupBy(*by, "ip").agg(F.count("*").alias("cnt"), F.max_by("ts", "arrival").alias("last"))


def rates(requests: DataFrame, by: Column, name: str, seconds: int = 10) -> DataFrame:
    """AGG-21: requests a second in each span of so many seconds (from its begin), by a column such as the status or the /24; partial counts travel."""
    begin = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("wall_ts").cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    counted = requests.where("wall_ts IS NOT NULL").groupBy(begin.alias("begin"), by.alias(name)).agg(F.count("*").alias("n"))
    return counted.select("begin", name, (F.col("n") / seconds).alias("rate"))
