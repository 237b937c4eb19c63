"""Near-duplicate embeddings by an inverted multi-index.

Both halves of a vector have a codebook of their own; a pair of codewords is a cell of the product grid.
A vector lives in its nearest cell and visits the cells nearest to it, in the order of the
multi-sequence algorithm, as many as reach the target recall for vectors at the threshold. What it meets
there is verified by its cosine in double precision. A pair is found if either of the two meets the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangewarden.llm._common import batched, freed, record, table, written
from rangewarden.llm.components import components

#: Distinct vectors that codebooks are fitted on, at most; vectors in a cell on average; members of a block.
SAMPLE, CELL, BLOCK = 20_000, 1024, 4096
#: Codewords of a half, at most: 16 million cells, which the sample can still tell apart.
CODEWORDS = 4096
#: Of vectors at the threshold, the share whose cell one of the two must visit.
TARGET = 0.999


def usable(vector: list | None) -> bool:
    return bool(vector) and None not in vector and bool(np.isfinite(v := np.array(vector, np.float64)).all()) and bool(np.abs(v).max() > 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the square of a component can't overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class MultiIndex:
    def __init__(self, sample: np.ndarray, codewords: int, threshold: float, target: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.cut = sample.shape[1] // 2
        self.books = [self._book(h, codewords, rng) for h in self._halves(sample)]
        self.visits = self._calibrate(sample, threshold, target, rng)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    @staticmethod
    def _book(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        """Codewords by k-means; a codeword that no vector is nearest to stays where it is."""
        book = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
        for _ in range(12):
            near = MultiIndex._distances(x, book).argmin(axis=1)
            n = np.bincount(near, minlength=len(book))
            sums = np.zeros_like(book)
            np.add.at(sums, near, x)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        return book

    @staticmethod
    def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)) if x.shape[1] else np.zeros((len(x), len(book)))

    def sequence(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The first cells of each vector's multi-sequence, nearest first; the first one is its own.

        The i-th and j-th nearest codewords of the halves can only be among the first n pairs if
        (i + 1)(j + 1) <= n, as all pairs of nearer ones come before; just those sums are sorted.
        """
        a, b = (self._distances(h, book) for h, book in zip(self._halves(x), self.books, strict=True))
        visits = min(visits or self.visits, a.shape[1] * b.shape[1])
        ra, rb = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        i, j = np.nonzero(np.outer(np.arange(1, min(a.shape[1], visits) + 1), np.arange(1, min(b.shape[1], visits) + 1)) <= visits)
        sums = np.take_along_axis(a, ra, 1)[:, i] + np.take_along_axis(b, rb, 1)[:, j]
        first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return (np.take_along_axis(ra, i[first], 1) * b.shape[1] + np.take_along_axis(rb, j[first], 1)).astype(np.int32)

    def _calibrate(self, sample: np.ndarray, threshold: float, target: float, rng: np.random.Generator) -> int:
        """Cells to visit so that either of two vectors at the threshold visits the other's, in the target's share of trials."""
        x = sample[rng.choice(len(sample), min(1024, len(sample)), replace=False)]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        y = unit(threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * away / np.where(size > 1e-9, size, 1.0)) if x.shape[1] > 1 else x
        rank = np.minimum(self._rank(x, self.sequence(y, 1)[:, 0]), self._rank(y, self.sequence(x, 1)[:, 0]))
        return int(np.quantile(rank, target, method="higher")) + 1

    def _rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells a vector visits before this one: those of pairs of codewords that are nearer in sum."""
        out = []
        for lo in range(0, len(x), 64):  # a part at a time: there may be very many cells
            a, b = (self._distances(h, book) for h, book in zip(self._halves(x[lo : lo + 64]), self.books, strict=True))
            i, j = np.divmod(cell[lo : lo + 64], b.shape[1])
            rows = np.arange(len(a))
            asked = a[rows, i] + b[rows, j]
            b.sort(axis=1)
            out.append([sum(np.searchsorted(b[k], asked[k] - a[k], side="left")) for k in range(len(a))])
        return np.concatenate(out).astype(np.int64)


def _fit(nodes: DataFrame, sample: int, cell: int, threshold: float, target: float) -> tuple[dict[int, MultiIndex], dict[tuple[int, int], int]]:
    """An index for each length of vectors, on those of the lowest hash; and how many blocks each cell has."""
    sizes = {r["d"]: r["n"] for r in nodes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for d, n in sizes.items():
        codewords = int(np.clip(np.ceil(np.sqrt(n / cell)), 1, CODEWORDS))
        picked = nodes.where(F.size("embedding") == d).select("embedding").orderBy(F.xxhash64("embedding")).limit(sample)
        x = unit(np.array([r[0] for r in picked.collect()], np.float64))
        out[d] = MultiIndex(x, codewords, threshold, target)
    return out


def _kinds(d: int, visits: int, number: str) -> tuple[np.dtype, np.dtype]:
    """Of a visitor, which knows its own cell, and of a member, which knows all cells it visits."""
    own = [("node", "<i8"), ("copies", "<i8"), ("vec", number, (d,))]
    return np.dtype([*own, ("home", "<i4")]), np.dtype([*own, ("cells", "<i4", (visits,))])


def _compare(visitors: np.ndarray, members: np.ndarray, units: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of visitors with a cell's members: nodes, their further links, and edges that join what is linked."""
    i, j = np.nonzero(unit(visitors["vec"]) @ units.T >= threshold)
    other = visitors["node"][i] != members["node"][j]
    i, j = i[other], j[other]
    # The member doesn't come upon the visitor in the visitor's own cell: this is its only chance.
    back = ~(members["cells"][j] == visitors["home"][i, None]).any(axis=1)
    nodes = np.r_[visitors["node"][i], members["node"][j[back]]]
    links = np.r_[members["copies"][j], visitors["copies"][i[back]]]
    nodes, at = np.unique(nodes, return_inverse=True)
    edges = np.stack([visitors["node"][i], members["node"][j]], axis=1)
    if len(edges) > len(visitors) + len(members):
        edges = _forest(edges)
    return nodes, np.bincount(at, links, len(nodes)).astype(np.int64), edges


def _forest(edges: np.ndarray) -> np.ndarray:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = root[p]
            x = root[x]
        return x

    kept = []
    for a, b in edges.tolist():
        p, q = find(a), find(b)
        if p != q:
            root[p] = q
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def embedding_groups(df: DataFrame, threshold: float = 0.95, target: float = TARGET, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of df (vec_id, embedding).

    Rows link if the cosine of their vectors is at least the threshold. Vectors that are null, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths. Equal
    vectors are one node with a number of copies, so no group of copies meets in pairs; of repeated rows each is a link of
    the others. A cell of many members is split into blocks, which every visitor of the cell meets.
    """
    spark = df.sparkSession
    batched(spark)
    # Components stay as they are, or become doubles.
    number = "<f4" if df.schema["embedding"].dataType == T.ArrayType(T.FloatType(), df.schema["embedding"].dataType.containsNull) else "<f8"
    plain = df.select("vec_id", F.col("embedding").cast("array<float>" if number == "<f4" else "array<double>").alias("embedding"))
    good = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = plain.withColumn("good", F.coalesce(good, F.lit(False)))
    nodes = written(rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    index = _fit(nodes, sample, cell, threshold, target)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(0).to_pylist()
            for d in {len(v) for v in vectors}:
                cells = index[d].sequence(unit(np.array([v for v in vectors if len(v) == d], number)), 1)[:, 0]
                yield record(pa.schema([("d", pa.int32()), ("cell", pa.int32())]), [d] * len(cells), pa.array(cells))

    # Only cells of more than a block: at most one for each so many vectors.
    crowded = nodes.select("embedding").mapInArrow(freed(home), "d int, cell int").groupBy("d", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    split = {(r["d"], r["cell"]): -(-r["n"] // block) for r in crowded.collect()}
    schema = pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("block", pa.int32()), ("visits", pa.bool_()), ("rows", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed members and visitors of each block of a cell."""
        for b in batches:
            vectors, node, copies = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            length = np.array(list(map(len, vectors)))
            out = []
            for d in np.unique(length).tolist():
                own = np.flatnonzero(length == d)
                visitor, member = _kinds(d, index[d].visits, number)
                packed, guests = np.zeros(len(own), member), np.zeros(len(own), visitor)
                packed["vec"] = [vectors[k] for k in own]
                packed["node"], packed["copies"], packed["cells"] = node[own], copies[own], index[d].sequence(unit(packed["vec"]))
                for c in ("node", "copies", "vec"):
                    guests[c] = packed[c]
                guests["home"] = packed["cells"][:, 0]
                # All visits in order of their cells: each cell's are a slice.
                order = np.argsort(packed["cells"], axis=None, kind="stable")
                cells, first = np.unique(packed["cells"].ravel()[order], return_index=True)
                for c, came in zip(cells.tolist(), np.split(order // packed["cells"].shape[1], first[1:]), strict=True):
                    comes, n = guests[came], split.get((d, c), 1)
                    lives = packed[came[packed["cells"][came, 0] == c]]
                    for k in range(n):
                        if len(here := lives[lives["node"] % n == k]):
                            out.append((d, c, k, False, here.tobytes()))
                        out.append((d, c, k, True, comes.tobytes()))
            if out:
                yield record(schema, *zip(*out, strict=True))

    found_schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members come before visitors; rows with links count them, rows with another node are edges."""
        now, members, units = None, [], None
        for b in batches:
            for d, c, k, visits, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (d, c, k) != now:
                    now, members, units = (d, c, k), [], None
                rows_ = np.frombuffer(data, _kinds(d, index[d].visits, number)[0 if visits else 1])
                if not visits:
                    members.append(rows_)
                    continue
                if not members:
                    continue
                if units is None:
                    members = [np.concatenate(members)]
                    units = unit(members[0]["vec"])
                nodes_, links, edges = _compare(rows_, members[0], units, threshold)
                if len(nodes_):
                    yield record(found_schema, pa.array(nodes_), pa.array(links), [None] * len(nodes_))
                    yield record(found_schema, pa.array(edges[:, 0]), [None] * len(edges), pa.array(edges[:, 1]))

    dealt = nodes.select("embedding", "node", "copies").mapInArrow(freed(deal), "d int, cell int, block int, visits boolean, rows binary")
    found = written(dealt.repartition(parts, "d", "cell", "block").sortWithinPartitions("d", "cell", "block", "visits").mapInArrow(freed(meet), "node long, links long, other long"))
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = nodes.join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = nodes.join(least, "component").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("good").join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = comp.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp
"""
