"""Exact duplicates by sorting contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.llm._common import batched, freed, record, table, written

#: Bytes of a content that a splitter of the range partitioning holds; sorting and comparing take whole contents.
HEAD = 64
#: Bytes of contents that a task remembers to fold copies.
FOLD = 32 << 20
#: A null doc_id goes last.
LAST = (1 << 63) - 1
_STANDS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("best", pa.int64()), ("best_row", pa.int64()), ("text_sha256", pa.string()), ("content", pa.binary())])
_STANDS_SQL = "doc_id long, row long, rep long, n long, best long, best_row long, text_sha256 string, content binary"
_MEMBERS = pa.schema([("rep", pa.int64()), ("group", pa.int64())])


def _better(a: tuple, b: tuple, largest: bool) -> tuple:
    """Of two (doc_id, row): the one that stays. A null doc_id gives way; of equal ones the earlier row stays."""
    rank = lambda x: (x[0] is not None, 0 if x[0] is None else x[0] if largest else -x[0], -x[1])
    return a if rank(a) >= rank(b) else b


def _stand_ins(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Each row with the row that stands in for it (rep): the first of equal content that the task remembers, which alone carries the content.

    Of the rows of a batch that one row stands in for, the first has their number and the best of them.
    """
    seen: dict[bytes, int] = {}
    size = 0
    for b in batches:
        first: dict[bytes, list] = {}
        rows: list[list] = []
        for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            body = text.encode().lower()
            if (found := first.get(body)) is not None:
                found[3] += 1
                found[4:6] = _better((found[4], found[5]), (doc, row), largest)
                rows.append([doc, row, found[2], None, None, None, found[6], None])
                continue
            rep = seen.get(body)
            rows.append(found := [doc, row, row if rep is None else rep, 1, doc, row, hashlib.sha256(body).hexdigest(), body if rep is None else None])
            first[body] = found
        for body, found in first.items():
            if found[7] is not None:
                size += len(body) + 100
                if size > FOLD:
                    seen.clear()
                    size = len(body)
                seen[body] = found[2]
        if rows:
            yield record(_STANDS, *zip(*rows, strict=True))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over stand-ins (rep, content) in order of content: each with the first of the equal ones before it as its group."""
    last, group = None, None
    for b in batches:
        groups = []
        reps = b.column(0).to_pylist()
        for rep, content in zip(reps, b.column(1).to_pylist(), strict=True):
            if content != last:
                last, group = content, rep
            groups.append(group)
        yield record(_MEMBERS, reps, groups)


def _ranged(df: DataFrame, text: Column) -> DataFrame:
    """df dealt by ranges of content. The splitters' sample goes to the driver, so a splitter is a content's start, and its hash where many share a start; equal contents share both."""
    return df.repartitionByRange(F.substring(text, 1, HEAD), F.sha2(text, 256))


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def exact_groups(df: DataFrame, keep_largest: bool = False) -> DataFrame:
    """Every row's group of equal contents: doc_id, keep_id, group_size, kept, text_sha256.

    Contents are whole texts in UTF-8 with A-Z lowered; null counts as empty. Of equal contents the
    smallest doc_id stays, or the largest with keep_largest; of rows that also share that doc_id the first stays.
    A null doc_id stays only if its group has no other, and an empty table gives no rows.

    Each task first collapses its own copies into stand-ins, so a content that fills a third of the
    table reaches the sort as a few rows for each task. Sampled splitters range-partition the contents,
    each partition is sorted externally, and equal neighbours are compared in full. Groups go back to
    the documents by stand-in, whose copies are a task's at most, so no key is hot.
    """
    batched(df.sparkSession)
    found = df.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # Written once: stand-ins must be the same for the sort and for the way back.
    stands = written(found.mapInArrow(freed(lambda b: _stand_ins(b, keep_largest)), _STANDS_SQL))
    order = stands.where("content IS NOT NULL").select("rep", "content", "text_sha256")
    order = order.repartitionByRange(F.substring("content", 1, HEAD), "text_sha256").sortWithinPartitions("content").select("rep", "content")
    members = written(order.mapInArrow(freed(_neighbours), "rep long, group long"))
    place = F.col("best") if keep_largest else F.bitwise_not("best")
    rank = F.struct(F.col("best").isNotNull().alias("known"), place.alias("place"), F.bitwise_not("best_row").alias("order"), "best", "best_row")
    parts = stands.where("n IS NOT NULL").select("rep", "n", rank.alias("rank")).join(members, "rep")
    groups = parts.groupBy("group").agg(F.sum("n").alias("group_size"), F.max("rank").alias("top")).select("group", "group_size", F.col("top.best").alias("keep_id"), F.col("top.best_row").alias("keep_row"))
    out = stands.select("doc_id", "row", "rep", "text_sha256").join(members.join(groups, "group"), "rep")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def _body(row: pa.StructArray) -> list[bytes]:
    return [(t or "").encode().lower() for t in row.field("text").to_pylist()]


def _folded(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (row, tie) without those whose content the same task has already passed on in a row that goes before them."""
    seen: dict[bytes, tuple[int, int]] = {}
    size = 0
    for b in batches:
        keep, row = [], b.column(0)
        for i, (doc, tie, body) in enumerate(zip(row.field("doc_id").to_pylist(), b.column(1).to_pylist(), _body(row), strict=True)):
            place = (LAST if doc is None else -doc if largest else doc, tie)
            before = seen.get(body)
            if before is not None and before <= place:
                continue
            if before is None:
                size += len(body) + 100
                if size > FOLD:
                    seen.clear()
                    size = len(body)
            seen[body] = place
            keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


def _first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of content: the first of each run of equal ones."""
    last = None
    for b in batches:
        keep = []
        for i, body in enumerate(_body(b.column(0))):
            if body != last:
                keep.append(i)
                last = body
        yield b.take(pa.array(keep, pa.int64()))


def exact_dedup(df: DataFrame, keep_largest: bool = False) -> DataFrame:
    """The rows of df (doc_id, text) that stay, with all its columns: of equal contents (see exact_groups) one row.

    That is the one of the smallest doc_id, or of the largest; a null doc_id gives way to any other. Of rows
    that share the doc_id too the one of the lowest hash over all columns stays, and of rows that are equal throughout any one.
    Each task drops copies of what it has passed on before the one shuffle: whole rows go to ranges of
    content, each range is sorted externally, and a row goes whose content equals that of the row before it.
    """
    batched(df.sparkSession)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).withColumn("tie", F.xxhash64("row"))
    rows = rows.mapInArrow(freed(lambda b: _folded(b, keep_largest)), rows.schema)
    doc = F.col("row.doc_id")
    ranged = _ranged(rows, _lowered(F.col("row.text"))).withColumn("content", _lowered(F.col("row.text")))
    order = ranged.sortWithinPartitions("content", doc.desc_nulls_last() if keep_largest else doc.asc_nulls_last(), "tie")
    return order.select("row").mapInArrow(freed(_first_of_runs), rows.select("row").schema).select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep_largest=True)


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d
"""
