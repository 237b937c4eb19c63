"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from rangewarden.llm._common import batched, freed, record, table, texts
from rangewarden.llm.vocab import LIMIT, WordTable

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
SCHEMA = "doc_id long, ids array<int>, decoded string"


class PieceCodec:
    """Encodes as the library does, with each distinct marked word segmented once.

    A marked word is a run of whitespace markers and what follows up to the next marker. No piece of a
    usable model has a marker after another character, so no piece crosses the start of a marked word,
    and the merges of one word don't depend on another. Models of which this isn't so, and models that
    normalize texts, are refused.
    """

    def __init__(self, path: str, limit: int = LIMIT):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(re.search(f"[^{MARK}]{MARK}", m.id_to_piece(i)) for i in range(m.get_piece_size())):
            raise ValueError("a piece of this model crosses a whitespace marker")
        if m.normalize("  ﬁ  ") != f"{MARK * 3}ﬁ{MARK * 2}":
            raise ValueError("this model normalizes texts")
        self.lead = m.encode("a")
        self.lead_text = m.decode(self.lead)
        self.words = WordTable(self._entries, limit)

    def words_of(self, text: str) -> list[str]:
        """The marked words of a text, each without its first marker."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def _entries(self, words: list[str]) -> list[tuple[str, str]]:
        """Each one's ids in decimal, and what they decode to after another word."""
        found = self.model.encode([w.replace(MARK, " ") for w in words], num_threads=1)
        found = [ids if w else [self.model.piece_to_id(MARK)] for w, ids in zip(words, found, strict=True)]
        decoded = self.model.decode([self.lead + ids for ids in found], num_threads=1)
        return [(" ".join(map(str, ids)), text[len(self.lead_text) :]) for ids, text in zip(found, decoded, strict=True)]

    def run(self, found: list[str], end_id: int | None) -> Iterator[tuple[str, str]]:
        """For each text: its ids in decimal, joined by blanks, and their decoded text."""
        for lo in range(0, len(found), 128):
            for got in self.words.rows([self.words_of(t) for t in found[lo : lo + 128]]):
                ids = " ".join([x[0] for x in got])
                # The library drops the blank that the first marker stands for.
                text = "".join([x[1] for x in got])[1:]
                if end_id is not None:
                    ids = f"{ids} {end_id}" if ids else str(end_id)
                yield ids, text


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_decode(df: DataFrame, model_path: str, end_id: int | None = 2) -> DataFrame:
    """doc_id, ids and their decoded text, for every row of df (doc_id, text).

    Null text counts as empty: it has the end id alone and decodes to the empty text. Repeated rows
    give repeated rows; other columns are ignored; an empty table gives no rows. Nothing is shuffled.
    """
    batched(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(codec(model_path).run(b.column(1).to_pylist(), end_id))
            yield record(schema, b.column(0), [[int(x) for x in ids.split()] for ids, _ in got], [text for _, text in got])

    return texts(df, "doc_id").mapInArrow(freed(run), SCHEMA)


def encode_decode_digests(df: DataFrame, model_path: str, end_id: int | None = 2) -> DataFrame:
    """As encode_decode(), with the number of ids and SHA-256 of both results in their place."""
    batched(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(codec(model_path).run(b.column(1).to_pylist(), end_id))
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            yield record(schema, b.column(0), [ids.count(" ") + 1 if ids else 0 for ids, _ in got], [sha(ids) for ids, _ in got], [sha(text) for _, text in got])

    return texts(df, "doc_id").mapInArrow(freed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
