"""Times the headline queries: python bench.py. BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rangewarden import queries as q
from rangewarden.operators import clusters, prefixes
from rangewarden.operators.clusters import ClusterSet
from rangewarden.shipping import shared_dir
from rangewarden.sources import logformat, synth

LINES = 1_000_000


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, make) -> None:
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)

    catalogue = q.queries()
    catalogue["unique_ips"](spark, sf_dir).collect()  # the JVM warms up
    for name in ("total_requests", "unique_ips", "trie_stats_filtered", "prefix_counts_d8_24", "cluster_standard", "cluster_multi_set", "cluster_lineitem", "cluster_percentages", "remove_whitelisted", "filter_combined", "parse_default", "parse_ip_only", "heatmap16", "grid_capture", "top_talkers", "window_cluster"):
        timed(name, lambda name=name: catalogue[name](spark, sf_dir))
    log = f"{shared_dir(spark)}/bench-{os.getpid()}"
    synth.synthetic_log(spark, LINES, 1).repartition(int(cpus)).write.text(log)
    lines = spark.read.option("lineSep", "\n").text(log)
    timed("log_1m_parse_all", lambda: logformat.parse_lines(lines, synth.FORMAT))
    timed("log_1m_parse_ips", lambda: logformat.parse_ips(lines, synth.FORMAT))
    timed("log_1m_counts", lambda: prefixes.address_counts(logformat.parse_ips(lines, synth.FORMAT)))
    timed("log_1m_clusters", lambda: clusters.detect(prefixes.address_counts(logformat.parse_lines(lines, synth.FORMAT).where(F.contains("user_agent", F.lit("Mozilla"))).select("ip")), [ClusterSet(1000, 16, 24, 0.2), ClusterSet(500, 24, 32, 0.1)]))
    import shutil

    shutil.rmtree(log)
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "lines_per_sec_parse_all": round(LINES / took["log_1m_parse_all"]), "lines_per_sec_parse_ips": round(LINES / took["log_1m_parse_ips"])}))
    spark.stop()


if __name__ == "__main__":
    main()
