"""Packing token streams into sequences of a fixed length, balanced by attention cost."""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rangewarden.llm._common import batched, freed, record, table, texts
from rangewarden.llm.vocab import encode_all

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def cost(length, linear: float = 1.0, quadratic: float = 1.0 / 1024):
    """What a document of this length costs: a linear part, and attention over itself."""
    return linear * length + quadratic * length * length


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Whole sequences are cut off first. What is left goes, longest first, to the sequence of the lowest
    cost that still has room for it; if none has, the roomiest one is filled up and the rest queues
    again by its length. There are as few sequences as can hold the tokens, so less than one of them is padding.
    """
    out, left, used = [], [], 0
    for d, n in enumerate(lengths):
        for s in range(0, n - n % capacity, capacity):
            out.append((d, s, capacity, used, 0))
            used += 1
        if n % capacity:
            left.append((n % capacity, -d, n - n % capacity))
    left.sort()
    bins = -(-sum(x[0] for x in left) // capacity)
    room, costs = np.full(bins, capacity, np.int64), np.zeros(bins)
    while left:
        n, d, s = left.pop()
        at = int(np.where(room >= n, costs, np.inf).argmin())
        if room[at] < n:
            at = int(room.argmax())
            take = int(room[at])
            insort(left, (n - take, d, s + take))
            n = take
        out.append((-d, s, n, used + at, int(capacity - room[at])))
        room[at] -= n
        costs[at] += cost(n, linear, quadratic)
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, shard_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the checksum of its ids.

    df: doc_id and text; other columns are ignored, null text counts as empty and still has its end id.
    Each task packs shards of about shard_tokens of its own input, so nothing is shuffled, memory is
    bounded, and a lost task repeats alike: a sequence's id is the task's number and a counter.
    Repeated rows and equal ids are packed as documents of their own. An empty table gives no rows.
    """
    batched(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, held, size, used = np.array([end_id], "<u4").tobytes(), [], 0, TaskContext.get().partitionId() << 36

        def flush() -> pa.RecordBatch:
            nonlocal held, size, used
            rows = []
            for d, s, n, q, o in pack([len(ids) // 4 for _, ids in held], capacity, linear, quadratic):
                doc, ids = held[d]
                rows.append((doc, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)]), len(ids) // 4, used + q, o))
            used, held, size = max((r[5] for r in rows), default=used - 1) + 1, [], 0
            return record(_ARROW, *zip(*rows, strict=True))

        for b in batches:
            docs = b.column(0).to_pylist()
            for doc, ids in zip(docs, encode_all(b.column(1).to_pylist(), tokenizer_path), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    return texts(df, "doc_id").mapInArrow(freed(run), SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
