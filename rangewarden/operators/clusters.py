"""CLU: the shallowest balanced prefixes that hold enough requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import cidr_text, prefix_of, size_of
from rangewarden.operators.prefixes import percent, prefix_counts


@dataclass(frozen=True)
class ClusterSet:
    min_size: int
    min_depth: int
    max_depth: int
    mean_subnet_difference: float
    use_for_jail: bool = False

    @property
    def milli(self) -> int:
        """The threshold in whole thousandths, cut off; negative ones are 0."""
        return int(max(self.mean_subnet_difference, 0.0) * 1000)


def detect(counts: DataFrame, sets: list[ClusterSet], *by: str, owners: list | None = None) -> DataFrame:
    """Detected ranges (set_id, start, len, cnt) of address counts, for all sets over one aggregation.

    A prefix is a candidate if it has min_size requests, and its depth is max_depth or its halves are
    balanced: both there, and equal or closer than the threshold's share of the count. Counts only fall
    along a path, so what a walk from the root would report are the candidates that have no candidate above them. Candidates
    nest or are disjoint, so a running maximum of their ends, in order of their starts, tells.
    The root's own count is 0, so /0 can only be reported for a min_size of 0; its reports count all.
    owners: for each set the value of the first of the columns ``by`` that it is for; without them each set is for all.
    """
    if not sets:
        raise ValueError("no cluster set")
    lo, hi = min(s.min_depth for s in sets), max(s.max_depth for s in sets)
    known = [
        F.struct(F.lit(i).alias("set_id"), F.lit(s.min_size).cast("long").alias("min_size"), F.lit(s.min_depth).alias("min_depth"), F.lit(s.max_depth).alias("max_depth"), F.lit(s.milli).cast("long").alias("milli"), F.lit(owners[i] if owners else None).alias("owner"))
        for i, s in enumerate(sets)
    ]
    least = min(s.min_size for s in sets)
    if least > 0 and lo > 0:
        # Counts only fall along a path: below a shortest prefix of fewer requests there is nothing to find, and most addresses are there.
        top = prefix_of(F.col("ip"), lo).alias("_top")
        heavy = counts.groupBy(*by, top).agg(F.sum("cnt").alias("_n")).where(F.col("_n") >= least).select(*by, "_top")
        counts = counts.select(*by, "ip", "cnt", top).join(heavy, [*by, "_top"], "left_semi").drop("_top")
    nodes = prefix_counts(counts, lo, hi, *by).where(F.col("cnt") >= least).select("*", F.explode(F.array(*known)).alias("s")).select("*", "s.*").drop("s")
    if owners:
        nodes = nodes.where(F.col("owner") == F.col(by[0]))
    balanced = (F.col("l") > 0) & (F.col("r") > 0) & ((F.col("l") == F.col("r")) | (2000 * F.abs(F.col("l") - F.col("r")) < F.col("milli") * F.col("cnt")))
    found = nodes.where("cnt >= min_size AND depth BETWEEN min_depth AND max_depth").where((F.col("depth") == F.col("max_depth")) | balanced)
    start = F.col("prefix") * size_of(F.col("depth"))
    found = found.select(*by, "set_id", start.alias("start"), F.col("depth").alias("len"), "cnt", "min_depth", (start + size_of(F.col("depth")) - 1).alias("end"))
    above = Window.partitionBy(*by, "set_id", prefix_of(F.col("start"), F.col("min_depth"))).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("end").over(above)).where("reach IS NULL OR reach < end").select(*by, "set_id", "start", "len", "cnt")


def cluster_report(counts: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """CLU-4: found ranges (with their cnt, as detect() gives them) as text with their requests and share of all; a /0 counts everything."""
    total = counts.groupBy(*by).agg(F.sum("cnt").alias("total"))
    joined = found.join(total, list(by)) if by else found.withColumn("total", F.coalesce(total.scalar(), F.lit(0).cast("long")))
    requests = F.when(F.col("len") == 0, F.col("total")).otherwise(F.col("cnt"))
    return joined.select(*by, "set_id", cidr_text(F.col("start"), F.col("len")).alias("cidr"), requests.alias("requests"), percent(requests, F.col("total")).alias("percent"))
