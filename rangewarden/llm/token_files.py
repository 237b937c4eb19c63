"""Token ids as a concatenated array with Elias-Fano encoded document boundaries.

A segment is one self-contained byte string:

    magic 'RWEF', version 1; n documents, n ids, universe of the keys; bytes of an id (2 or 4)
    the ids of all documents, one after another
    an Elias-Fano sequence of the n boundaries (ids up to each document's end)
    an Elias-Fano sequence of the doc_ids less the first one; the first doc_id and the number of nulls

An Elias-Fano sequence of n ascending values below u keeps the low floor(log2(u/n)) bits of each value
packed, and the high parts in unary: 2 + log2(u/n) bits a value. Every 256th one bit's place is kept as
a 32-bit sample, so select reads a bounded stretch of the high bits. There is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.llm._common import BATCH_ROWS, batched, freed, record, shared_dir, table, texts
from rangewarden.llm.vocab import encode_all

SAMPLE = 256
_HEAD = struct.Struct("<4sIQQB")
_EF = struct.Struct("<QQBQQ")
_KEYS = struct.Struct("<qQ")


class EliasFano:
    """An ascending sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, u = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        flags[places] = 1
        return cls(n, u, bits, low, np.packbits(flags, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def _lows(self, lo: int, hi: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(hi - lo, np.int64)
        a, b = lo * self.low_bits, hi * self.low_bits
        flags = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return flags.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """The values from the lo-th up to the hi-th, from the sample before them and the stretch of high bits up to the sample after them."""
        if lo >= hi:
            return np.zeros(0, np.int64)
        first, after = lo // SAMPLE, -(-hi // SAMPLE)
        at, skip = int(self.samples[first]) // 8, int(self.samples[first]) % 8
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        block = np.unpackbits(self.high[at:stop], bitorder="little")
        block[:skip] = 0
        places = np.flatnonzero(block)[lo - first * SAMPLE : hi - first * SAMPLE] + at * 8
        return (places - np.arange(lo, hi)) << self.low_bits | self._lows(lo, hi)

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (places - np.arange(self.n)) << self.low_bits | self._lows(0, self.n)

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.universe, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        n, u, bits, a, b = _EF.unpack_from(data, at)
        at += _EF.size
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        k = -(-n // SAMPLE)
        return cls(n, u, bits, low, high, np.frombuffer(data, "<u4", k, at + a + b)), at + a + b + 4 * k


def encode_segment(doc_ids: list, ids: list[bytes]) -> bytes:
    """A segment of documents in ascending order of doc_id, nulls first; ids: each one's little-endian 32-bit ids."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    nulls = sum(d is None for d in doc_ids)
    first = doc_ids[nulls] if nulls < len(doc_ids) else 0
    keys = EliasFano.of([d - first for d in doc_ids[nulls:]])
    return _HEAD.pack(b"RWEF", 1, len(ids), len(flat), width) + flat.astype(f"<u{width}").tobytes() + EliasFano.of(ends).to_bytes() + keys.to_bytes() + _KEYS.pack(first, nulls)


class Segment:
    def __init__(self, data: bytes):
        magic, version, self.n_docs, self.n_ids, width = _HEAD.unpack_from(data)
        if (magic, version) != (b"RWEF", 1):
            raise ValueError("not a token segment")
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, _HEAD.size)
        self.ends, at = EliasFano.from_bytes(data, _HEAD.size + width * self.n_ids)
        keys, at = EliasFano.from_bytes(data, at)
        self.keys = keys
        self.first, self.nulls = _KEYS.unpack_from(data, at)

    def doc_ids(self, lo: int, hi: int) -> list:
        known = (self.keys.select_range(max(0, lo - self.nulls), max(0, hi - self.nulls)) + self.first).tolist()
        return [None] * (hi - lo - len(known)) + known

    def document(self, i: int) -> np.ndarray:
        """The i-th document's ids, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def documents(self, lo: int, hi: int) -> tuple[np.ndarray, list[bytes]]:
        """Where the documents from lo up to hi start, and their ids, little-endian unsigned 32-bit: by select, without a table of all boundaries."""
        ends = self.ends.select_range(max(0, lo - 1), hi)
        ends = ends if lo else np.r_[0, ends]
        flat = self.ids[ends[0] : ends[-1]].astype("<u4").tobytes()
        places = (4 * (ends - ends[0])).tolist()
        return ends[:-1], [flat[a:b] for a, b in zip(places, places[1:], strict=False)]


_SEGMENTS = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    docs, held, size, start, part = [], [], 0, 0, None

    def segment() -> pa.RecordBatch:
        return record(_SEGMENTS, [part], [start], [size], [encode_segment(docs, held)])

    for b in batches:
        for p, doc, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if held and (p != part or size >= limit):
                yield segment()
                docs, held, size, start = [], [], 0, start + size
            start, part = (start if p == part else 0), p
            docs.append(doc)
            held.append(ids)
            size += len(ids) // 4
    if held:
        yield segment()


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int, segment_ids: int = 1_000_000) -> None:
    """Encodes df's doc_id and text and writes token segments under path, in ascending order of doc_id.

    The files go through Spark's writer, so path may be in any store. Ranges of doc_id, cut at sampled
    quantiles, make the parts; in a part rows are sorted by doc_id, rows of the same doc_id by their ids'
    bytes, nulls come first. A segment holds about segment_ids, so memory is bounded. Null text counts as
    empty and still has its end id. An empty table gives files without segments.
    """
    batched(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The quantiles need doc_id alone; Spark's own range partitioner would encode all texts once more for its sample.
    cuts = df.select("doc_id").where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    part = F.expr(f"cast(array_size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> doc_id > c)) as int)") if cuts else F.lit(0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            yield record(schema, b.column(0), b.column(1), [x + end for x in encode_all(b.column(2).to_pylist(), tokenizer_path)])

    keyed = texts(df, "doc_id").select(part.alias("part"), "doc_id", "text").mapInArrow(freed(encode), "part int, doc_id long, ids binary")
    ranged = keyed.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    ranged.mapInArrow(freed(lambda b: _segments(b, segment_ids)), "part int, part_start long, n_ids long, segment binary").write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token segments: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit)."""
    kept = spark.read.schema("part int, part_start long, n_ids long, segment binary").parquet(path)
    bases, total = [], 0
    for part, n in sorted(kept.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row for each part of the files
        bases.append((part, total))
        total += n
    at = spark.createDataFrame(bases, "part int, base long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Segment(data)
                for lo in range(0, s.n_docs, BATCH_ROWS):
                    hi = min(s.n_docs, lo + BATCH_ROWS)
                    starts, ids = s.documents(lo, hi)
                    yield record(schema, s.doc_ids(lo, hi), starts + start, ids)

    return kept.join(F.broadcast(at), "part").select((F.col("base") + F.col("part_start")).alias("start"), "segment").mapInArrow(freed(documents), "doc_id long, start long, ids binary")


def digests(df: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2).to_pylist()
            yield record(schema, b.column(0), b.column(1), [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids])

    return df.mapInArrow(freed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return digests(read_token_files(spark, path))
