"""Near duplicates by SimHash fingerprints, compared exactly in tiles."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.llm._common import batched, drop_written, freed, record, table, texts, written
from rangewarden.llm.components import components

#: Fingerprints of a tile: a pair of full tiles takes 2^26 comparisons.
TILE = 8192
#: Tiles of a strip.
TOGETHER = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Words compared at once, so that they stay in a core's cache; pairs found that are turned into edges at once.
AT_ONCE, FOUND = 1 << 16, 1 << 20
#: Bits of a block by which words of two tiles are matched: below the least all words are compared, beyond the most they don't count.
LEAST_BITS, MOST_BITS = 8, 16
#: Groups of texts with a common hash up to this size are compared pair by pair; rows of groups, and pairs, at once.
SMALL, MEET, PAIRS = 64, 1 << 16, 1 << 18
#: Tiles of texts that travel together: a task compares one such strip with another.
STRIP = 8
#: Texts, the nearest by fingerprint, that a text of a large group meets at first.
NEAREST = 8
#: Documents (at least, and a share of all), and characters of each, that tell which hashes are common, and how many are held: it changes the work, not the result.
SAMPLE, SAMPLE_SHARE, SAMPLE_CHARS, COMMON = 2000, 1 / 64, 4000, 1 << 17
_FIRSTS = np.dtype([("hash", "<i8"), ("key", "<i8"), ("fp", "<u8"), ("n", "<i8"), ("at", "<i8")])
_OPEN = np.dtype([("hash", "<i8"), ("key", "<i8"), ("fp", "<u8"), ("n", "<i8"), ("at", "<i8"), ("label", "<i8")])
_PAIRS = np.dtype([("a", "<i8"), ("b", "<i8"), ("tree", "?"), ("hash", "<i8")])


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 (seed 42) of each run of so many words, repeats included; of the whole sequence if it is shorter; none without words.

    A-Z is lowered, and words end at the blank and the characters 09-0D.
    """
    found = text.encode().lower().split()
    if not found:
        return []
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [h(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [h(joined[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        block = np.array(hashes[lo : lo + BLOCK], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    batched(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(shingle_hashes(t, words)) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield record(schema, b.column(0), pa.array(found.view(np.int64)))

    return texts(df, "doc_id").mapInArrow(freed(run), "doc_id long, fp long")


def matches(words: np.ndarray, radius: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each of radius + 1 blocks of bits: its first bit, its mask, the words' places in order of the block, and where each value begins. None if the blocks are too short to tell words apart."""
    out, cuts = [], [64 * k // (radius + 1) for k in range(radius + 2)]
    if cuts[1] < LEAST_BITS:
        return out
    for lo, hi in itertools.pairwise(cuts):
        mask = (1 << min(hi - lo, MOST_BITS)) - 1
        value = (words >> np.uint64(lo) & np.uint64(mask)).astype(np.int64)
        out.append((lo, mask, np.argsort(value, kind="stable"), np.r_[0, np.cumsum(np.bincount(value, minlength=mask + 1))]))
    return out


def near_words(a: np.ndarray, b: np.ndarray, radius: int, known: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all words of a and b that differ in at most radius bits, in parts; a pair may come more than once. known: matches() of b.

    Words that near agree in one of radius + 1 blocks of bits at least: only those that do are compared by exclusive-or, unless so many do that comparing all is less work.
    """
    known = matches(b, radius) if known is None else known
    asked = []
    for lo, mask, order, begins in known:
        value = (a >> np.uint64(lo) & np.uint64(mask)).astype(np.int64)
        asked.append((order, begins[value], begins[value + 1] - begins[value]))
    if not asked or sum(int(n.sum()) for _, _, n in asked) * 16 > len(a) * len(b):
        step = max(1, AT_ONCE // max(1, len(b)))
        for lo in range(0, len(a), step):
            near = np.bitwise_count(a[lo : lo + step, None] ^ b[None]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                yield i + lo, j
        return
    for order, first, n in asked:
        i = np.repeat(np.arange(len(a)), n)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first, n)]
        near = np.bitwise_count(a[i] ^ b[j]) <= radius
        if near.any():
            yield i[near], j[near]


def linked(a: np.ndarray, b: np.ndarray, radius: int, same: bool, known: list | None = None) -> np.ndarray:
    """Edges between places of a, then b, that join whatever words differ in at most radius bits; with same, a is b. known: matches() of b.

    The edges of a part of the pairs lead to the first place each place reaches: no more than places, however many pairs are near.
    """
    edges: list[np.ndarray] = []
    shift = 0 if same else len(a)

    def join(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        label = np.arange(len(b) + shift)
        while True:
            least = np.minimum(label[i], label[j])
            if (label[i] == least).all() and (label[j] == least).all():
                break
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
        far = np.flatnonzero(label != np.arange(len(label)))
        edges.append(np.stack([label[far], far], axis=1))

    waiting, n = [], 0
    for i, j in near_words(a, b, radius, known):
        j = j + shift
        i, j = i[i < j], j[i < j]
        if len(i):
            waiting.append((i, j))
            n += len(i)
        if n >= FOUND:
            join(waiting)
            waiting, n = [], 0
    if waiting:
        join(waiting)
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def near_pairs(fps: DataFrame, radius: int, tile: int = TILE, together: int = TOGETHER) -> DataFrame:
    """Edges (a, b) that link all pairs of distinct fingerprints (fp) at most radius bits apart.

    Fingerprints are dealt into tiles by the bits set in their two halves; a tile holds at most about
    ``tile`` of them. A pair of tiles whose counts differ by more than the radius in sum is skipped, as
    no pair in it can be near; any other pair of tiles is compared by exclusive-or and bit counts, see near_words().
    Tiles are dealt into strips of about ``together``; a task compares one strip with another, so a tile
    travels once for each strip and not once for each tile it meets.
    """
    spark = fps.sparkSession
    batched(spark)
    halves = fps.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"))
    sizes = halves.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).alias("parts"))  # at most 33 x 33 rows
    tiles = halves.join(F.broadcast(sizes), ["hi", "lo"]).withColumn("part", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
    tiles = written(tiles.groupBy("hi", "lo", "part").agg(F.collect_list("fp").alias("fps")))
    strips = max(1, -(-tiles.count() // together))
    # Strip s meets all strips: with itself as (s, s), and with another one as (smaller, larger).
    own = F.pmod(F.xxhash64("hi", "lo", "part"), F.lit(strips)).cast("int")
    dealt = tiles.select(own.alias("strip"), "hi", "lo", "part", "fps").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    dealt = dealt.select((F.least("strip", "other") * strips + F.greatest("strip", "other")).alias("block"), "strip", "hi", "lo", "part", "fps")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(place: int | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i, (strip, hi, lo, part, a, _) in enumerate(held):
            for other, hi2, lo2, part2, b, known in held[i:]:
                same = (strip, hi, lo, part) == (other, hi2, lo2, part2)
                # Tiles of one strip meet in the block of that strip alone.
                if abs(hi - hi2) + abs(lo - lo2) > radius or strip == other and place != strip * strips + strip:
                    continue
                found, both = linked(a, b, radius, same, known), (a if same else np.r_[a, b]).view(np.int64)
                if len(found):
                    yield record(schema, pa.array(both[found[:, 0]]), pa.array(both[found[:, 1]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                place = batch.column(0)[k].as_py()
                if place != now:
                    yield from block(now, held)
                    now, held = place, []
                words = np.array(batch.column(5)[k].values).view(np.uint64)
                held.append((*(batch.column(c)[k].as_py() for c in range(1, 5)), words, matches(words, radius)))
        yield from block(now, held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(freed(run), "a long, b long")


def simhash_groups(df: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable over links.

    Documents link if their fingerprints differ in at most radius bits. Null text counts as empty;
    texts without words have fingerprint zero and link like any other. Repeated rows get a row each;
    an empty table gives none. Copies of a fingerprint are one node, so they never meet in pairs.
    """
    docs = written(fingerprints(df, words))
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(near_pairs(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    groups = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = groups.join(least, "component").select("fp", "component_id")
    return docs.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def prefix(hashes: np.ndarray, common: np.ndarray, seen: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's sorted hashes in an order that holds for all sets: sets as similar as this share one of their first ones.

    Hashes that a sample saw often (common, sorted, and how often) come last, so that few sets share a first one by chance.
    """
    if not len(hashes):
        return np.zeros(1, "<u8")
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, seen[at], 0)
    return hashes[np.lexsort([hashes, rank])][: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def _may_be_similar(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m hashes, whose first common one is at these places, can be as similar."""
    return (np.minimum(n, m) >= similarity * np.maximum(n, m)) & (np.minimum(n - at, m - to) * (1 + similarity) >= similarity * (n + m) - 1e-6)


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each value of the last bits of distinct hashes, at least as many as hashes: whether an odd number has it."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities_allow(x: bytes, n: int, y: bytes, m: int, similarity: float) -> bool:
    """Whether sets of n and m hashes with these parities can be as similar: each odd bit of both together is a hash of one only."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6


def _pairs(a: np.ndarray, b: np.ndarray, tree: bool = False) -> np.ndarray:
    out = np.zeros(len(a), _PAIRS)
    out["a"], out["b"], out["tree"] = np.minimum(a["key"], b["key"]), np.maximum(a["key"], b["key"]), tree
    out["hash"] = a["hash"]
    return out


def _rows_before(group: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For parts of a group, from a place on: which of the rows before each row may be similar to it."""
    k = len(group)
    for at in range(0, k, max(1, BLOCK // k)):
        part = group[at : at + max(1, BLOCK // k), None]
        before = np.arange(k)[None] < np.arange(at, at + len(part))[:, None]
        yield at, before & _may_be_similar(part["n"], part["at"], group["n"], group["at"], similarity)


def grown(group: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """A forest over a group: each row's root; and the pairs of each row with the rows before it of the nearest fingerprints within the radius, of which the nearest is its tree's."""
    label, found = np.arange(len(group)), []
    for at, may in _rows_before(group, similarity):
        far = np.where(may, np.bitwise_count(group["fp"][at : at + len(may), None] ^ group["fp"][None]), 65)
        nearest = np.argpartition(far, min(NEAREST, far.shape[1] - 1), axis=1)[:, :NEAREST]
        away = np.take_along_axis(far, nearest, 1)
        first = away.argmin(axis=1)
        rows = np.arange(len(may))
        tree = np.flatnonzero(away[rows, first] <= radius)
        label[tree + at] = nearest[tree, first[tree]]
        found.append(_pairs(group[tree + at], group[label[tree + at]], True))
        i, c = np.nonzero(away <= radius)
        found.append(_pairs(group[i + at], group[nearest[i, c]]))
    while (label[label] != label).any():
        label = label[label]
    return label, found


def group_pairs(rows: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """All of pairs_of_groups() at once."""
    return np.concatenate([np.zeros(0, _PAIRS), *pairs_of_groups(rows, radius, similarity)])


def pairs_of_groups(rows: np.ndarray, radius: int, similarity: float) -> Iterator[np.ndarray]:
    """Of rows sorted by hash: pairs (a, b, tree, hash) of keys that share a hash and may be similar, in parts.

    In groups of more than SMALL each one meets those before it whose fingerprints are nearest, if they are within the radius
    (the nearest makes a tree), and besides only those that no chain of trees' pairs joins it with.
    """
    new = np.r_[True, rows["hash"][1:] != rows["hash"][:-1]]
    size = np.diff(np.r_[np.flatnonzero(new), len(rows)])
    small = rows[np.repeat((size > 1) & (size <= SMALL), size)]
    for d in range(1, SMALL):
        a, b = small[:-d], small[d:]
        same = a["hash"] == b["hash"]
        if not same.any():
            break
        a, b = a[same], b[same]
        may = _may_be_similar(a["n"], a["at"], b["n"], b["at"], similarity)
        yield _pairs(a[may], b[may])
    for lo, k in zip(np.flatnonzero(new)[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        group = rows[lo : lo + k]
        label, near = grown(group, radius, similarity)
        yield from near
        for at, may in _rows_before(group, similarity):
            i, j = np.nonzero(may & (label[at : at + len(may), None] != label[None]))
            yield _pairs(group[i + at], group[j])


def open_pairs(rows: np.ndarray, radius: int, similarity: float) -> Iterator[np.ndarray]:
    """Of rows sorted by hash, with the groups of linked texts they are in (label): what one tree joins and links don't. All but the largest linked group of a tree meet the others of the tree."""
    new = np.r_[True, rows["hash"][1:] != rows["hash"][:-1]]
    for group in np.split(rows, np.flatnonzero(new)[1:]):
        tree, _ = grown(group, radius, similarity)
        order = np.argsort(tree, kind="stable")
        for own in np.split(group[order], np.flatnonzero(np.diff(tree[order])) + 1):
            labels, n = np.unique(own["label"], return_counts=True)
            for x in own[own["label"] != labels[n.argmax()]] if len(labels) > 1 else ():
                y = own[(own["label"] != x["label"]) & _may_be_similar(x["n"], x["at"], own["n"], own["at"], similarity)]
                yield _pairs(np.full(len(y), x), y)


def common_hashes(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that a sample of the texts holds more than once, sorted, and how often."""
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE / max(1, docs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(shingle_hashes(text, words), dtype="<u8")).view(np.int64))], names=["hash"])

    picked = docs.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    seen = picked.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).mapInArrow(freed(run), "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    often = seen.orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes, times = (often.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes.view("<u8"))
    return hashes.view("<u8")[order], times[order].astype(np.int64)


def profiles(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of each text (key, doc, text) a row with its number of distinct shingles n and their parities odd, and a row for each of the first hashes of its shingles."""
    common, times = common_hashes(docs, words)
    schema = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("doc", pa.int64()), ("odd", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int, tuple] = {}
            for key, doc, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if (key, doc) not in own:
                    hashes = shingle_hashes(text, words)
                    distinct = np.unique(np.array(hashes, dtype="<u8"))
                    own[key, doc] = (prefix(distinct, common, times, similarity), fingerprint(hashes), len(distinct), parities(distinct))
            if own:
                keys, docs_ = (np.array(x, np.int64) for x in zip(*own, strict=True))
                found, fps, sizes, odd = zip(*own.values(), strict=True)
                fps, sizes = np.array(fps, np.uint64).view(np.int64), np.array(sizes, np.int32)
                none = [None] * len(own)
                yield record(schema, none, keys, fps, sizes, none, docs_, list(odd))
                k = np.array(list(map(len, found)))
                at = np.concatenate([np.arange(x, dtype=np.int32) for x in k])
                none = pa.nulls(len(at), pa.int64())
                yield record(schema, np.concatenate(found).view(np.int64), np.repeat(keys, k), np.repeat(fps, k), np.repeat(sizes, k), at, none, pa.nulls(len(at), pa.binary()))

    return docs.select("key", "doc", "text").mapInArrow(freed(run), "hash long, key long, fp long, n int, at int, doc long, odd binary")


def in_parts(found: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Pairs, about PAIRS of them held at once. One may come from many hashes: once in a part is enough, but for those of trees."""
    waiting, n = [], 0
    for part in itertools.chain(found, [None]):
        if part is not None:
            waiting.append(part)
            n += len(part)
        if n and (part is None or n >= PAIRS):
            both = np.concatenate(waiting)
            waiting, n = [], 0
            both["hash"][~both["tree"]] = 0
            both = both[np.lexsort([both[c] for c in ("hash", "tree", "b", "a")])]  # sorting whole records takes far longer
            yield both[np.r_[True, np.any([both[c][1:] != both[c][:-1] for c in _PAIRS.names], axis=0)]]


def met(rows: DataFrame, kind: np.dtype, fn) -> DataFrame:
    """Pairs (a, b) that fn makes, in parts, of the rows of one hash or more, which it gets together, sorted by hash and key; and the hashes in whose trees a pair is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, most = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                part = np.zeros(b.num_rows, kind)
                for i, c in enumerate(kind.names):
                    part[c] = b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) if c == "fp" else b.column(i).to_numpy(zero_copy_only=False)
                waiting.append(part)
                most += len(part)
            if not waiting or (b is not None and most < MEET):
                continue
            part = np.concatenate(waiting)
            part = part[np.r_[True, (part["hash"][1:] != part["hash"][:-1]) | (part["key"][1:] != part["key"][:-1])][: len(part)]]
            # The last group may go on in the next batch.
            end = len(part) if b is None or not len(part) else int(np.searchsorted(part["hash"], part["hash"][-1]))
            waiting, most = [part[end:]], 0
            for found in in_parts(fn(part[:end])) if end else ():
                for lo in range(0, len(found), MEET):
                    yield pa.RecordBatch.from_arrays([pa.array(found[c][lo : lo + MEET]) for c in _PAIRS.names], names=list(_PAIRS.names))

    out = rows.select(*kind.names).repartition("hash").sortWithinPartitions("hash", "key").mapInArrow(freed(run), "a long, b long, tree boolean, hash long")
    return out.groupBy("a", "b").agg(F.collect_set(F.when(F.col("tree"), F.col("hash"))).alias("hashes"))


def verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """A table of those of the pairs (a, b) whose texts are that similar: by their parities first, so that few need their shingles."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = [parities_allow(*r, similarity) for r in zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)]
            yield b.select([0, 1]).filter(pa.array(may, pa.bool_()))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [_similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(near, pa.bool_()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(np.array(shingle_hashes(t, words), dtype="<u8")).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], names=["key", "set"])

    side = lambda df, value, k, *more: df.select(F.col("key").alias(k), F.col(value).alias(f"{k}_{value}"), *[F.col(c).alias(f"{k}_{c}") for c in more])
    both = pairs.select("a", "b").join(side(known, "odd", "a", "n"), "a").join(side(known, "odd", "b", "n"), "b").select("a", "b", "a_odd", "a_n", "b_odd", "b_n")
    rest = written(both.mapInArrow(freed(allowed), "a long, b long"))
    asked = rest.select(F.col("a").alias("key")).union(rest.select("b")).distinct()
    sets = written(docs.select("key", "text").join(asked, "key", "left_semi").mapInArrow(freed(hashed), "key long, set binary").dropDuplicates(["key"]))
    links = written(rest.join(side(sets, "set", "a"), "a").join(side(sets, "set", "b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(freed(judged), "a long, b long"))
    drop_written(rest, sets)
    return links


def near_texts(known: DataFrame, radius: int, similarity: float, tile: int = TILE, together: int = STRIP) -> DataFrame:
    """Pairs (a, b) of texts (key, fp, n) with near fingerprints: each text with the nearest, NEAREST at most, of those before it within the radius.

    Texts are dealt into tiles of about ``tile`` by their number of shingles, in classes such that similar texts are in
    the same or in neighbouring ones; each pair of tiles of such classes is compared in full by exclusive-or and bit counts.
    A task compares one strip of ``together`` tiles with another, or with itself.
    """
    spark = known.sparkSession
    batched(spark)
    step = -math.log(min(max(similarity, 0.01), 0.99))
    rows = known.select("key", "fp", F.floor(F.log(F.greatest("n", F.lit(1))) / step).cast("int").alias("size"))
    sizes = sorted((r["size"], -(-r["count"] // tile)) for r in rows.groupBy("size").count().collect())  # a row a class
    strips = [(size, k) for size, tiles in sizes for k in range(-(-tiles // together))]
    meet = [(s, t) for s in range(len(strips)) for t in range(s, len(strips)) if abs(strips[t][0] - strips[s][0]) <= 1]
    blocks = [(*strips[x], x, i) for i, (s, t) in enumerate(meet) for x in {s, t}]
    tiles = rows.join(F.broadcast(spark.createDataFrame(sizes, "size int, tiles int")), "size").withColumn("tile", F.expr("cast(pmod(xxhash64(key), tiles) as int)"))
    tiles = tiles.groupBy("size", "tile").agg(F.collect_list(F.struct("key", "fp")).alias("rows")).withColumn("k", F.expr(f"tile div {together}").cast("int"))
    dealt = tiles.join(F.broadcast(spark.createDataFrame(blocks, "size int, k int, strip int, block int")), ["size", "k"]).select("block", "strip", "tile", "rows")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("far", pa.int32())])

    def nearest(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = max(1, AT_ONCE // len(x))
        for lo in range(0, len(y), rows):
            far = np.bitwise_count(y[lo : lo + rows, None] ^ x[None])
            if same:
                far[np.arange(len(x))[None] >= np.arange(lo, lo + len(far))[:, None]] = 65
            if len(i := np.flatnonzero(far.min(axis=1) <= radius)):
                far = far[i]
                j = np.argpartition(far, min(NEAREST, far.shape[1]) - 1, axis=1)[:, :NEAREST]
                away = np.take_along_axis(far, j, 1)
                r, c = np.nonzero(away <= radius)
                yield i[r] + lo, j[r, c], away[r, c]

    def block(place: int | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        alone = bool(held) and meet[place][0] == meet[place][1]
        for k, (strip, keys, y) in enumerate(held):
            for other, keys_before, x in held[: k + 1]:
                if strip != other or alone:
                    for i, j, far in nearest(x, y, x is y):
                        yield record(schema, keys_before[j], keys[i], far.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                place, strip = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                if place != now:
                    yield from block(now, held)
                    now, held = place, []
                keys, fps = batch.column(3)[n].values.flatten()
                held.append((strip, keys.to_numpy(), fps.to_numpy().view(np.uint64)))
        yield from block(now, held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, "block").sortWithinPartitions("block", "strip", "tile").mapInArrow(freed(run), "a long, b long, far int")
    few = found.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "a"))), 1, NEAREST).alias("nearest"))
    return few.select(F.explode("nearest.a").alias("x"), "b").select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()


def similar_links(first: DataFrame, docs: DataFrame, words: int, radius: int, similarity: float) -> list[DataFrame]:
    """Tables of links (a, b) between texts (key, text) of that similarity: two texts as similar are linked, directly or by others.

    first: the texts' profiles. SimHash comes first: texts whose fingerprints tiles show to be near (see near_texts) are verified by all
    their shingles, and what links stays together. The exact way for the rest, which is beyond the radius: texts that similar share one of the first hashes of their shingles (see prefix), so only those that do
    meet, and each pair that may be similar is verified by all its shingles. In groups of more than SMALL a tree of near fingerprints
    stands for the pairs it joins (see group_pairs). Where a pair of a tree fails, groups of linked texts may be left that
    the tree joined and the links don't: under each hash whose tree has such a pair, all but the largest of these meet the others.
    """
    hashes, known = first.where("hash IS NOT NULL"), first.where("hash IS NULL").select("key", "fp", "odd", "n").dropDuplicates(["key"])
    near = written(near_texts(known, radius, similarity))
    links = [verified(near, known, docs, words, similarity)]
    drop_written(near)
    label = components(links[0])

    def apart_in(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that links don't join."""
        side = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)").select(*pairs.columns)

    pairs = written(apart_in(met(hashes, _FIRSTS, lambda rows: pairs_of_groups(rows, radius, similarity))))
    links.append(verified(pairs, known, docs, words, similarity))
    failed = written(pairs.where("size(hashes) > 0").join(links[1], ["a", "b"], "left_anti").select("a", "b", F.explode("hashes").alias("hash")))
    drop_written(pairs, label)
    if not failed.isEmpty():
        label = components(functools.reduce(DataFrame.union, links))
        apart = apart_in(failed).select("hash").distinct()
        again = hashes.join(apart, "hash", "left_semi").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("component", "key"))
        more = written(met(again, _OPEN, lambda rows: open_pairs(rows, radius, similarity)))
        drop_written(label)
        if not more.isEmpty():
            links.append(verified(more, known, docs, words, similarity))
        drop_written(more)
    drop_written(failed)
    return links


def near_duplicates(df: DataFrame, words: int = 5, radius: int = 12, similarity: float = 0.8) -> DataFrame:
    """The rows of df that stay, with all its columns: of each group of similar texts (doc_id, text) the one of the smallest doc_id.

    Texts are linked if the Jaccard similarity of their distinct runs of so many words is at least as given, and a group is what
    links reach. All links are found, see similar_links(): radius changes the work, not the result.
    Null text counts as empty, and texts without words are alike; a null doc_id counts as the largest. Rows with the same
    doc_id and text stay or go together; of different texts with the smallest doc_id one stays. An empty table gives no rows.
    """
    batched(df.sparkSession)
    doc = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc")
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("carried"), doc, F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    docs = keyed.select("key", "doc", "text")
    first = written(profiles(docs, words, similarity))
    links = similar_links(first, docs, words, radius, similarity)
    found = components(functools.reduce(DataFrame.union, links)).withColumnRenamed("node", "key")
    members = first.where("hash IS NULL").select("key", "doc").distinct().join(found, "key")
    stays = members.groupBy("component").agg(F.min(F.struct("doc", "key")).alias("stays"))
    gone = written(members.join(stays, "component").where("key <> stays.key").select("key", "doc"))
    drop_written(first, found, *links)
    return keyed.join(gone, ["key", "doc"], "left_anti").select("carried.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
