"""Removal of byte strings that an earlier document already holds, by names of growing length.

Prefix doubling names the strings that start at each position, sorts the names, drops positions whose
name is unique and goes on with longer strings until the threshold. Over every position of a corpus
each round would shuffle some 24 bytes a byte of text. Two things make the rounds small and lose nothing:

* Round 1 names only anchors. The anchor of a window of 50 bytes is its 20-byte string of the lowest
  hash (the first of equal ones), so equal windows have equal anchors at the same place in them, and
  about one position in sixteen is the anchor of any window. Anchors of unique name drop out: no window
  around them repeats.
* Round 2 names the whole stretch of windows that share an anchor (50 to 80 bytes). A stretch that a
  smaller document holds is covered as a whole.
* Round 3 names each single window of the stretches that are left, which lie around the ends of repeats.

Names travel as packed arrays, one row for each batch of documents and each of the buckets that the
anchors are dealt into; each bucket is sorted by its names as a whole. Before that each batch settles
repeats within itself, so a document copied a million times sends its names once a batch. The names
within a bucket have 80 bits, and 64 of round 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangewarden.llm._common import batched, drop_written, freed, mix, record, table, written

#: Bytes of a window and of an anchor. Stretches of up to 2 * WINDOW - ANCHOR bytes are named by ten words.
WINDOW, ANCHOR = 50, 20
#: Windows that are looked at at once; their places take 24 bits of a key.
BLOCK = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
#: Buckets for each task, and windows that are named at once within a batch.
SPLIT, AT_ONCE = 3, 1 << 18
#: A null doc_id counts as larger than any other.
LAST = (1 << 63) - 1

_NAMES = np.dtype([("anchor", "<u4"), ("high", "<u4"), ("low", "<u2"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("n", "u1")])
_WINDOWS = np.dtype([("name", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i8"), ("n", "u1"), ("bucket", "<i4")])
_RUNS = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("n", "<u4")])
#: Columns that are packed as differences.
_STEPS = ("doc", "tag", "at")
#: Rows are settled spans, packed names of a bucket, or stretches whose windows go on, with their bucket.
_SPANS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary())])
_SPANS_SQL = "doc long, tag long, at long, n int, bucket int, names binary"
_KEY = [f"coalesce(doc_id, {LAST}L) AS doc", "xxhash64(body) AS tag"]


def words_at(body: bytes, n: int) -> np.ndarray:
    """The 8-byte words that start at each of the first n places."""
    return np.ndarray((n,), "<u8", body, 0, (1,))


def anchors(body: bytes) -> tuple[np.ndarray, ...]:
    """For each stretch of windows with one anchor: first window, number of windows, hash of the anchor and of the stretch."""
    parts = []
    for base in range(0, len(body) - WINDOW + 1, BLOCK):
        b = body[base : base + BLOCK + WINDOW - 1]
        x, k = words_at(b, len(b) - 7), len(b) - ANCHOR + 1
        h = mix(x[:k])
        for o in (8, ANCHOR - 8):
            h = mix(h ^ x[o : o + k])
        low = (h & ~_PLACE) | np.arange(k, dtype=np.uint64)
        wide, span = WINDOW - ANCHOR + 1, 1
        while span * 2 <= wide:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        place = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        n = np.diff(np.r_[first, len(place)])
        end = first + n + WINDOW - 1
        s = mix(n.astype(np.uint64))
        for at in (*(first + o for o in range(0, WINDOW - 8, 8)), *(end - o for o in (32, 24, 16, 8))):
            s = mix(s ^ x[at])
        parts.append((first + base, n, h[place[first]], s))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def window_names(body: bytes, at: np.ndarray) -> np.ndarray:
    x, s = words_at(body, len(body) - 7), np.zeros(len(at), np.uint64)
    for o in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        s = mix(s ^ x[at + o])
    return s


def first_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where groups begin in sorted keys."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return new


def settle(rows: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """rows in order of their names and documents, and which of them have a smaller document with the same names."""
    rows = rows[np.lexsort([rows["doc"], *(rows[c] for c in names[::-1])])]
    new = first_of(*(rows[c] for c in names))
    least = rows["doc"][new][np.cumsum(new) - 1] if len(rows) else rows["doc"]
    return rows, rows["doc"] > least


def joined(rows: np.ndarray) -> np.ndarray:
    """Runs of windows of the same text that follow on one another, as (doc, tag, at, bytes)."""
    rows = rows[np.lexsort([rows["at"], rows["tag"], rows["doc"]])]
    end = rows["at"].astype(np.int64) + rows["n"]
    new = first_of(rows["doc"], rows["tag"])
    new[1:] |= rows["at"][1:] > end[:-1]
    first = np.flatnonzero(new)
    out = np.zeros(len(first), [("doc", "<i8"), ("tag", "<i8"), ("at", "<i8"), ("n", "<i4")])
    for c in ("doc", "tag", "at"):
        out[c] = rows[c][first]
    if len(first):
        out["n"] = np.maximum.reduceat(end, first) - out["at"] + WINDOW - 1
    return out


def spans_record(spans: np.ndarray, bucket: int = -1) -> pa.RecordBatch:
    return record(_SPANS, *(pa.array(np.ascontiguousarray(spans[c]), type=_SPANS.field(c).type) for c in ("doc", "tag", "at", "n")), pa.array([bucket] * len(spans), pa.int32()), [None] * len(spans))


def packed(rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: its names in order of their places in the texts, column by column, texts and places as differences, compressed."""
    order = np.lexsort([rows["at"], rows["tag"], rows["doc"], bucket])
    rows, bucket = rows[order], bucket[order]
    first = np.flatnonzero(first_of(bucket))
    squeeze, blobs = zstandard.ZstdCompressor(level=1), []
    for part in np.split(rows, first[1:]) if len(rows) else []:
        columns = [part[c].copy() for c in part.dtype.names]
        for c in _STEPS:
            columns[part.dtype.names.index(c)][1:] -= part[c][:-1]
        # Bytes of the same weight lie together, so those that hardly change take no room.
        blobs.append(squeeze.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)))
    return names_record(bucket[first], blobs)


def unpacked_names(blobs: list[bytes]) -> np.ndarray:
    plain = list(map(zstandard.ZstdDecompressor().decompress, blobs))
    sizes = [len(b) // _NAMES.itemsize for b in plain]
    out, lo = np.zeros(sum(sizes), _NAMES), 0
    for b, n in zip(plain, sizes, strict=True):
        at = 0
        for c in _NAMES.names:
            width = _NAMES[c].itemsize
            column = np.frombuffer(b, np.uint8, n * width, at).reshape(width, n).T.copy().view(_NAMES[c]).ravel()
            out[c][lo : lo + n] = np.cumsum(column, dtype=column.dtype) if c in _STEPS else column
            at += n * width
        lo += n
    return out


def unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    """Arrays that lie column by column."""
    sizes = [len(b) // kind.itemsize for b in blobs]
    out, lo = np.zeros(sum(sizes), kind), 0
    for b, n in zip(blobs, sizes, strict=True):
        at = 0
        for c in kind.names:
            out[c][lo : lo + n] = np.frombuffer(b, kind[c], n, at)
            at += n * kind[c].itemsize
        lo += n
    return out


def packed_windows(rows: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: the number of runs of windows, the runs, and the windows' names in their order."""
    rows = rows[np.lexsort([rows["at"], rows["tag"], rows["doc"], rows["bucket"]])]
    new = first_of(rows["bucket"], rows["doc"], rows["tag"])
    new[1:] |= rows["at"][1:] != rows["at"][:-1] + 1
    first = np.flatnonzero(new)
    runs = np.zeros(len(first), _RUNS)
    for c in ("doc", "tag", "at"):
        runs[c] = rows[c][first]
    runs["n"] = np.diff(np.r_[first, len(rows)])
    blobs, own = [], rows["bucket"][first]
    begins = np.flatnonzero(first_of(own))
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(first)], strict=True):
        stop = first[hi] if hi < len(first) else len(rows)
        blobs.append(np.int64(hi - lo).tobytes() + b"".join(runs[c][lo:hi].tobytes() for c in _RUNS.names) + rows["name"][first[lo] : stop].tobytes())
    return names_record(own[begins], blobs)


def unpacked_windows(blobs: list[bytes]) -> np.ndarray:
    sizes = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
    runs = unpacked([b[8 : 8 + k * _RUNS.itemsize] for b, k in zip(blobs, sizes, strict=True)], _RUNS)
    n = runs["n"].astype(np.int64)
    out = np.zeros(int(n.sum()), _WINDOWS)
    out["name"] = np.concatenate([np.frombuffer(b, "<u8", -1, 8 + k * _RUNS.itemsize) for b, k in zip(blobs, sizes, strict=True)])
    out["doc"], out["tag"] = np.repeat(runs["doc"], n), np.repeat(runs["tag"], n)
    out["at"] = np.repeat(runs["at"] - np.cumsum(n) + n, n) + np.arange(len(out))
    out["n"] = 1
    return out


def names_record(bucket: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return record(_SPANS, *([None] * len(blobs) for _ in range(4)), pa.array(bucket.astype(np.int32)), blobs)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], pa.RecordBatch | None]]:
    """Of a partition that is sorted by bucket: the packed arrays of each bucket; and the spans, which pass through."""
    now, blobs = None, []
    for b in batches:
        plain = b.filter(pc.is_null(b.column("names")))
        if plain.num_rows:
            yield -1, [], plain
        b = b.filter(pc.is_valid(b.column("names")))
        for bucket, names in zip(b.column("bucket").to_pylist(), b.column("names").to_pylist(), strict=True):
            if bucket != now and blobs:
                yield now, blobs, None
                blobs = []
            now = bucket
            blobs.append(names)
    if blobs:
        yield now, blobs, None


def repeat_spans(df: DataFrame) -> DataFrame:
    """A table of the byte ranges (doc, tag, spans of at and n) covered by windows that start in a document with a smaller doc_id; they may overlap.

    df: doc_id and body, the text's bytes. tag, a 64-bit hash of the text, tells apart different texts of one doc_id.
    """
    spark = df.sparkSession
    batched(spark)
    docs = df.selectExpr(*_KEY, "body")
    # More buckets than tasks: one at a time is in a worker's memory.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = SPLIT * parts

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rounds 1 and 2 within a batch: covered stretches as spans, the other names packed."""
        for b in batches:
            found = []
            for doc, tag, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if len(body) < WINDOW:
                    continue
                at, n, anchor, stretch = anchors(body)
                rows = np.zeros(len(at), [*_NAMES.descr, ("bucket", "<i4")])
                rows["anchor"], rows["bucket"] = anchor.astype(np.uint32), (mix(anchor) >> np.uint64(32)) % np.uint64(buckets)
                rows["high"], rows["low"] = stretch >> np.uint64(32), stretch.astype(np.uint16)
                rows["doc"], rows["tag"], rows["at"], rows["n"] = doc, tag, at, n
                found.append(rows)
            if found:
                rows, covered = settle(np.concatenate(found), ["bucket", "anchor", "high", "low"])
                yield packed(rows[~covered][list(_NAMES.names)], rows["bucket"][~covered])
                yield spans_record(joined(rows[covered]))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rounds 1 and 2 of a bucket: spans, and the stretches whose windows go on."""
        for bucket, blobs, plain in gathered(batches):
            if plain:
                yield plain
                continue
            rows, covered = settle(unpacked_names(blobs), ["anchor", "high", "low"])
            yield spans_record(joined(rows[covered]))
            rows = rows[~covered]
            new = first_of(rows["anchor"])
            first = np.flatnonzero(new)
            if len(first):
                # Round 1: an anchor in one document only, or one whose stretches are all covered by the first, has nothing left.
                several = np.minimum.reduceat(rows["doc"], first) != np.maximum.reduceat(rows["doc"], first)
                rows = rows[several[np.cumsum(new) - 1]]
                if len(rows):
                    yield spans_record(rows, bucket)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Round 3 within a batch."""
        for b in batches:
            found, size = [], 0
            for doc, tag, body, places in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                start = np.array([p["at"] for p in places], np.int64)
                n, own = np.array([p["n"] for p in places], np.int64), np.array([p["bucket"] for p in places], np.int32)
                if size and size + n.sum() > AT_ONCE:
                    yield from settled(found)
                    found, size = [], 0
                size += int(n.sum())
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows = np.zeros(len(at), _WINDOWS)
                rows["name"], rows["bucket"] = window_names(body, at), np.repeat(own, n)
                rows["doc"], rows["tag"], rows["at"], rows["n"] = doc, tag, at, 1
                found.append(rows)
            if found:
                yield from settled(found)

    def settled(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, covered = settle(np.concatenate(found), ["name"])
        yield packed_windows(rows[~covered])
        yield spans_record(joined(rows[covered]))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Round 3 of a bucket."""
        for _, blobs, plain in gathered(batches):
            if plain:
                yield plain
                continue
            rows, covered = settle(unpacked_windows(blobs), ["name"])
            yield spans_record(joined(rows[covered]))

    def dealt(found: DataFrame, fn) -> DataFrame:
        # Settled spans need no company: they are dealt anywhere.
        to = F.when(F.col("bucket") >= 0, F.col("bucket") % parts).otherwise(F.expr(f"cast(pmod(xxhash64(doc, at), {parts}) AS int)"))
        return found.repartitionById(parts, to).sortWithinPartitions("bucket").mapInArrow(freed(fn), _SPANS_SQL)

    one = written(dealt(docs.mapInArrow(freed(names), _SPANS_SQL), stretches))
    # Sets: rows of one doc_id and text repeat their places.
    goes_on = one.where("bucket >= 0").groupBy("doc", "tag").agg(F.collect_set(F.struct("at", "n", "bucket")).alias("parts"))
    two = written(dealt(docs.join(goes_on, ["doc", "tag"]).select("doc", "tag", "body", "parts").mapInArrow(freed(windows), _SPANS_SQL), single))
    spans = written(one.where("bucket < 0").union(two).groupBy("doc", "tag").agg(F.collect_set(F.struct("at", "n")).alias("spans")))
    drop_written(one, two)
    return spans


def cut_spans(body: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of body without these (at, n); bytes removed; maximal runs removed."""
    kept, end, removed, runs = [], 0, 0, 0
    for at, stop in sorted((s["at"], s["at"] + s["n"]) for s in spans):
        if at > end or (at == 0 and end == 0):
            kept.append(body[end:at])
            runs += 1
        removed += max(0, stop - max(at, end))
        end = max(end, stop)
    kept.append(body[end:])
    return b"".join(kept), removed, runs


def without_repeats(df: DataFrame, *keep: str, as_text: bool = False) -> DataFrame:
    """Every row of df (doc_id, text, and the columns to keep), with what is left of its text.

    Each byte goes that lies in a 50-byte string which also starts in a document with a smaller doc_id;
    strings are judged on the input, and never cross documents. Null text counts as empty, a null doc_id
    as larger than any other; rows of the same doc_id don't cover one another. An empty table gives no rows.
    Returns doc_id, the kept columns, left binary (the remaining bytes), n_bytes, n_removed, n_spans; a kept column
    of one of these names gives way. as_text: left is a string, without the bytes of characters that were cut.
    """
    batched(df.sparkSession)
    keep = tuple(c for c in keep if c not in ("doc_id", "left", "n_bytes", "n_removed", "n_spans"))
    carried = F.struct(F.col("doc_id"), *[F.col(f"`{c}`") for c in keep]).alias("carried")
    plain = df.select("doc_id", carried, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    spans = repeat_spans(plain.select("doc_id", "body"))
    full = plain.select("*", *map(F.expr, _KEY)).join(spans, ["doc", "tag"], "left").select("carried", "body", "spans")
    out = T.StructType([full.schema["carried"], *(T.StructField(c, t) for c, t in (("left", T.StringType() if as_text else T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, found = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            rows = [(body, 0, 0) if not s else cut_spans(body, s) for body, s in zip(bodies, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([r[0].decode(errors="ignore") for r in rows], pa.string()) if as_text else pa.array([r[0] for r in rows], pa.binary()), *(pa.array(c, pa.int64()) for c in (list(map(len, bodies)), [r[1] for r in rows], [r[2] for r in rows]))], names=out.names)

    return full.mapInArrow(freed(run), out).select("carried.*", "left", "n_bytes", "n_removed", "n_spans")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"))
