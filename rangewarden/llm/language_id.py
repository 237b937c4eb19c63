"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangewarden.llm._common import batched, freed, record, table

#: Components of a vector; letters of an n-gram.
DIM, GRAM = 1024, 3
#: Letters have codes below this; all letters beyond the Latin ones share 512 codes by their places. 0 ends words.
CODES = 1024
#: Rows of n-gram vectors that a worker keeps: 1 KB each.
KEPT = 24_000
#: Documents a model is fitted on, at most.
SAMPLE = 4000
UNKNOWN = "und"


def letter_codes(text: str) -> np.ndarray:
    """Codes of the lower-case letters of a text; a run of anything else is one 0. Starts and ends with 0; just [0] without letters."""
    points = np.frombuffer(("".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() and not _latin(text) else text.lower()).encode("utf-32-le"), "<u4")
    letter = _LETTER[np.minimum(points, len(_LETTER) - 1)] if len(points) else np.zeros(0, bool)
    codes = np.where(letter, np.where(points < 512, points, 512 + points % 512), 0).astype(np.int64)
    codes = np.r_[0, codes, 0]
    return codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]


def _latin(text: str) -> bool:
    return max(text) < "ɐ"


_LETTER = np.array([chr(i).isalpha() for i in range(0x250)] + [True])


class Letters:
    """Random vectors of letters, and of n-grams: the product of each letter's vector, rotated by its place."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = 1):
        self.gram = gram
        self.letters = (np.random.default_rng(seed).integers(0, 2, (CODES, dim), np.int8) * 2 - 1).astype(np.int8)
        self.dim, self.at, self.rows = dim, {}, np.zeros((KEPT, dim), np.int8)

    def bind(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dim), np.int8)
        for p in range(self.gram):
            out *= np.roll(self.letters[grams // CODES ** (self.gram - 1 - p) % CODES], p, axis=1)
        return out

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Rows of these n-grams' vectors. A full table is emptied first."""
        found = [self.at.get(g, -1) for g in grams.tolist()]
        if -1 in found:
            new = [g for g, p in zip(grams.tolist(), found, strict=True) if p < 0]
            if len(self.at) + len(new) > KEPT:
                self.at.clear()
                new = grams.tolist()
            for lo in range(0, len(new), 4096):
                part = new[lo : lo + 4096]
                self.rows[len(self.at) : len(self.at) + len(part)] = self.bind(np.array(part))
                self.at.update(zip(part, range(len(self.at), len(self.at) + len(part)), strict=True))
            found = [self.at[g] for g in grams.tolist()]
        return np.array(found, np.int64)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the vectors of all n-grams of a whole text; None without letters."""
        codes = letter_codes(text) if text else np.zeros(1, np.int64)
        if len(codes) < 3:
            return None
        grams = np.zeros(len(codes) - self.gram + 1, np.int64)
        for p in range(self.gram):
            grams = grams * CODES + codes[p : len(codes) - self.gram + 1 + p]
        grams, n = np.unique(grams, return_counts=True)
        out = np.zeros(self.dim, np.float64)
        for lo in range(0, len(grams), KEPT // 4):
            out += n[lo : lo + KEPT // 4].astype(np.float32) @ self.rows[self.places(grams[lo : lo + KEPT // 4])].astype(np.float32)
        return out


_LETTERS: list[Letters] = []


def letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


_HELD = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2"


def fit(df: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from documents with a language that aren't held out.

    At most ``sample`` documents, those of the lowest hash of doc_id, are bundled; each weighs alike. Of
    prototypes the mean of all of them is taken away, so what languages share doesn't count.
    """
    spark = df.sparkSession
    batched(spark)
    picked = df.where(f"lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND NOT ({_HELD})").select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample)
    train = df.select("doc_id", "lang", "text").join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi").where("lang IS NOT NULL AND text IS NOT NULL")
    schema = pa.schema([("lang", pa.string()), ("total", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = letters().bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
        if sums:
            yield record(schema, list(sums), [v.tobytes() for v in sums.values()])

    sums: dict[str, np.ndarray] = {}
    for lang, total in sorted(train.select("lang", "text").mapInArrow(freed(run), "lang string, total binary").collect()):  # a row for each language and task
        sums[lang] = sums.get(lang, 0) + np.frombuffer(total)
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((0, DIM))
    protos = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    if len(langs) > 1:
        protos = protos - protos.mean(axis=0)
    return langs, protos / np.linalg.norm(protos, axis=1, keepdims=True)


def _scored(texts: list, langs: list[str], protos: np.ndarray) -> tuple[list[str], list[float]]:
    preds, scores = [], []
    for text in texts:
        v = letters().bundle(text) if len(langs) else None
        near = protos @ v / (np.linalg.norm(v) or 1.0) if v is not None else None
        preds.append(UNKNOWN if near is None else langs[int(near.argmax())])
        scores.append(0.0 if near is None else float(np.clip(near.max(), 0, 1)))
    return preds, scores


def identify(df: DataFrame, langs: list[str], protos: np.ndarray) -> DataFrame:
    """df's columns with lang_pred and score: the prototype of the highest cosine to the whole text, and that cosine, 0 at least.

    A text that is null or has no letters gets 'und' and 0, as does any text if no language was learned; of equal cosines the first
    language in order stays. Columns of df that are called lang_pred or score give way; every other column passes through; nothing is shuffled.
    Very long texts are bundled as a whole, n-grams in parts.
    """
    batched(df.sparkSession)
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")])
    at = plain.columns.index("text")
    out = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            preds, scores = _scored(b.column(at).to_pylist(), langs, protos)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=out.names)

    return plain.mapInArrow(freed(run), out)


def with_language(df: DataFrame, langs: list[str], protos: np.ndarray) -> DataFrame:
    """The rows of df whose text has letters, with all their columns; where the column lang is null it gets the prediction, if a language was learned."""
    batched(df.sparkSession)
    if not langs:
        return lettered(df)
    names = df.columns
    at, lang = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            preds, _ = _scored(b.column(at).to_pylist(), langs, protos)
            columns = [*b.columns]
            if lang is not None:
                columns[lang] = pc.coalesce(columns[lang], pa.array(preds, columns[lang].type))
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([p != UNKNOWN for p in preds], pa.bool_()))

    return df.mapInArrow(freed(run), df.schema)


def lettered(df: DataFrame) -> DataFrame:
    """The rows of df whose text has letters."""
    batched(df.sparkSession)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(t) and len(letter_codes(t)) > 2 for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(freed(run), df.schema)


def predict_languages(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of df (doc_id, text, lang).

    A row is held out if crc32 of its doc_id as text leaves 2 when divided by 4 (a null doc_id isn't);
    see fit() and identify() for the rest. Repeated rows get a row each; an empty table gives none.
    """
    langs, protos = fit(df, sample)
    return identify(df.select("doc_id", "text"), langs, protos).select("doc_id", F.expr(f"coalesce({_HELD}, false)").alias("held_out"), "lang_pred", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))
