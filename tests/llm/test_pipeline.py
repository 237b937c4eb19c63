import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm import brute_pipeline
from tests.llm.test_dedup import frame, texts


def key(rows):
    return sorted(str(sorted(r.items(), key=str)) for r in rows)


def check_pieces(pieces, docs):
    """Pieces tile each document's ids, with their checksums, and sequences have no gaps."""
    library, by_doc, by_sequence = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == {r["doc_id"] for r in docs}
    for r in docs:
        ids, at = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + p["length"]].tobytes()))
            at += p["length"]
        assert at == len(ids)
    for mine in by_sequence.values():
        at = 0
        for p in sorted(mine, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024


@pytest.mark.parametrize("lang", [None, "xx"])
def test_run_is_the_brute_force_version(spark, tmp_path, lang):
    found = [t for t in texts(140, 9) if t is not None] + [None, "12 34", "the same text", "The Same TEXT", "<|endoftext|> inside"]
    docs = [{"doc_id": i * 7 % 1000, "text": t, "lang": lang if i % 3 else None, "source": f"s{i % 2}", "n_chars": len(t or "")} for i, t in enumerate(found)]
    spark.createDataFrame([tuple(r.values()) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows, now = docs, table
    for name, stage in pipeline.STAGES[:-1]:
        rows = getattr(brute_pipeline, name)(rows)
        now = stage(spark, now, str(tmp_path))
        assert now.columns == table.columns, name
        if lang and name == "language":
            rows = [{**r, "lang": lang} for r in rows]  # the only language there is to learn
        assert key(r.asDict() for r in now.collect()) == key(rows), name
    assert 0 < len(rows) < len(docs) and any(r["n_chars"] < len(docs[[d["doc_id"] for d in docs].index(r["doc_id"])]["text"]) for r in rows)
    check_pieces([r.asDict() for r in pipeline.run(spark, str(tmp_path)).collect()], rows)


@pytest.mark.parametrize("lang", ["cast(null as string)", "if(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2, 'en', null)"])
def test_no_language_learned(spark, lang):
    df, rows = frame(spark, [*texts(60, 10), "12 34", "...", "é"])
    df = df.selectExpr("doc_id", "text", f"{lang} as lang", "row as source", "n as n_chars")
    want = [r for r in df.collect() if any(c.isalpha() for c in r["text"] or "")]
    got = pipeline.language(spark, df, "").collect()
    assert 0 < len(want) < len(rows) and sorted(map(str, got)) == sorted(map(str, want))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
