"""Plain prefix doubling over every byte position, with Spark's joins and sorts: the measure that suffix_dedup is held against.

A position's rank stands for the string of so many bytes that starts there: at first its 8 bytes themselves, then, at growing
offsets, the order of the pair of its rank and the rank at the offset. Positions whose string occurs in one document only
drop out after each round. It is exact and needs no hash, but each round moves every position that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangewarden.llm._common import batched, drop_written, freed, record, written

#: Bytes of a first rank, and the offsets that lead from there to 50 bytes.
FIRST, OFFSETS = 8, (8, 16, 18)


def positions(df: DataFrame) -> DataFrame:
    """doc, tag, at and rank: the 8 bytes at each place of the texts (doc, tag, body)."""
    batched(df.sparkSession)
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int64()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, tag, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(body) - FIRST + 1
                if n > 0:
                    words = np.ndarray((n,), "<i8", body, 0, (1,))
                    for lo in range(0, n, 1 << 16):
                        part = words[lo : lo + (1 << 16)]
                        yield record(schema, np.full(len(part), doc), np.full(len(part), tag), np.arange(lo, lo + len(part)), part)

    return df.select("doc", "tag", "body").mapInArrow(freed(run), "doc long, tag long, at long, rank long")


def repeated_windows(df: DataFrame) -> DataFrame:
    """doc, tag and at of each 50-byte string of the texts (doc, tag, body) that also starts in a smaller doc."""
    now = positions(df)
    kept: list[DataFrame] = []
    for i, offset in enumerate(OFFSETS):
        ahead = Window.partitionBy("doc", "tag").orderBy("at").rangeBetween(offset, offset)
        pairs = written(now.withColumn("next", F.first("rank").over(ahead)).where("next IS NOT NULL"))
        several = pairs.groupBy("rank", "next").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
        # The new rank is a place in the order of the pairs.
        ranks = written(several.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").select("rank", "next", "least", F.monotonically_increasing_id().alias("place")))
        now = written(pairs.join(ranks, ["rank", "next"]).select("doc", "tag", "at", F.col("place").alias("rank"), "least"))
        drop_written(pairs, ranks, *kept)
        kept = [now]
        if i < len(OFFSETS) - 1:
            now = now.drop("least")
    return now.where("doc > least").select("doc", "tag", "at")
