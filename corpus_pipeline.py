"""A corpus pipeline of five operators: each stage works on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.llm._common import drop_written, table, written
from rangewarden.llm.exact_dedup import exact_dedup
from rangewarden.llm.language_id import fit, with_language
from rangewarden.llm.packing import pack_documents
from rangewarden.llm.simhash import near_duplicates
from rangewarden.llm.suffix_dedup import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null text, or no letters. A language column is the prediction's where it was null.

    If no language could be learned, it stays as it was.
    """
    return with_language(docs, *fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that similarities of 0.8 or more of their runs of five words link, the smallest doc_id stays."""
    return near_duplicates(docs, words=5, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of each text what a document of a smaller doc_id already holds in 50 bytes or more; bytes of a character that was cut go too.

    n_chars follows the text. A document stays even if nothing is left of it.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("carried")
    found = without_repeats(docs.select("doc_id", "text", carried), "carried", as_text=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("left").alias("text"), "n_chars": F.length("left").cast("long").alias("n_chars")}
    return found.select(*[own[c] if c in own else F.col(f"carried.`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("repeats", repeats), ("pack", pack)]

#: Fingerprints, repeats and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
