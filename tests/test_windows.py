import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rangewarden.operators.windows import address_stats, survivors

NOW = datetime(2025, 1, 1)


def left(spark, rows, cutoff, size):
    df = spark.createDataFrame(rows, "ts timestamp_ntz, arrival long, ip long")
    return sorted(r["arrival"] for r in survivors(df, F.lit(cutoff).cast("timestamp_ntz"), size).collect())


def test_bounds(spark):
    rows = [(NOW - timedelta(seconds=a), i, i + 1) for i, a in enumerate((25, 20, 15, 10, 5))]
    assert left(spark, rows, NOW - timedelta(seconds=12), 100) == [3, 4]
    assert left(spark, rows, NOW - timedelta(seconds=12), 1) == [4]
    assert left(spark, rows, NOW - timedelta(seconds=120), 2) == [3, 4]


def test_young_head_shields_old_rows(spark):
    rows = [(NOW + timedelta(hours=1), 0, 1), (NOW - timedelta(hours=9), 1, 2), (NOW, 2, 3)]
    assert left(spark, rows, NOW - timedelta(hours=1), 100) == [0, 1, 2]


def test_against_a_queue(spark):
    rng = random.Random(2)
    queue, arrival, kept = [], 0, []
    for step in range(4):
        new = [(NOW + timedelta(minutes=step * 10 - rng.randint(0, 30)), arrival + i, rng.randint(1, 4)) for i in range(15)]
        arrival += 15
        cutoff = NOW + timedelta(minutes=step * 10 - 15)
        queue += new
        while queue and queue[0][0] < cutoff:
            queue.pop(0)
        queue = queue[-20:]
        df = spark.createDataFrame(kept + new, "ts timestamp_ntz, arrival long, ip long")
        kept = [tuple(r) for r in survivors(df, F.lit(cutoff).cast("timestamp_ntz"), 20).collect()]
        assert sorted(r[1] for r in kept) == [r[1] for r in queue]
    stats = address_stats(spark.createDataFrame(kept, "ts timestamp_ntz, arrival long, ip long")).collect()
    assert sum(r["cnt"] for r in stats) == len(queue)
