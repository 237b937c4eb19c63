import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rangewarden.llm.packing import pack, pack_documents
from rangewarden.llm.piece_codec import PieceCodec, encode_decode, encode_decode_digests
from rangewarden.llm.token_files import EliasFano, Segment, digests, encode_segment, read_token_files, write_token_files
from rangewarden.llm.vocab import WordTable, encode_all

ODD = ["a", "the", "Tion", " ", "  ", "\n", "\t", ".", "é", "ß", "İ", "́", "中", "😀", "▁", "\x00", "\x1c", "\x85", "\xa0", "　", "'s", "1", "ΑΣ", "ﬁ", "\r\n", "½", "ǅ", "\xad", "</s>", "<0x41>", "<|endoftext|>", "<|startoftext|>", "<|ENDofTEXT|>", "<|endof", "text|>", "\x01"]
TEXTS = st.lists(st.sampled_from(ODD), max_size=14).map("".join) | st.text(max_size=40)


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    plain = Tokenizer.from_file(P.path(name))

    @settings(max_examples=400, deadline=None)
    @given(TEXTS)
    def same(text):
        assert ids(encode_all([text], P.path(name))[0]) == plain.encode(text, add_special_tokens=False).ids

    same()


def test_pieces_are_the_librarys():
    path = P.path("piece_bpe_32k.model")
    plain, codec = sentencepiece.SentencePieceProcessor(model_file=path), PieceCodec(path, limit=3)

    @settings(max_examples=400, deadline=None)
    @given(TEXTS)
    def same(text):
        want = [*plain.encode(text), 2]
        ((got, decoded),) = codec.run([text], 2)
        assert (got, decoded) == (" ".join(map(str, want)), plain.decode(want))

    same()


def test_word_tables_stay_bounded():
    table = WordTable(lambda ws: [w.upper() for w in ws], limit=4)
    for _ in range(3):
        assert table.rows([["a", "b"], list("cdefgh"), []]) == [["A", "B"], list("CDEFGH"), []]
    table.rows([["z"]])
    assert len(table.entries) <= 8


def test_piece_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "ab  c", "y")], "doc_id long, text string, ids string")
    rows = sorted(encode_decode(df, P.path("piece_bpe_32k.model")).collect())
    assert [r["ids"] for r in rows[:2]] == [[2], [2]] and rows[2]["decoded"] == "ab  c"
    assert encode_decode_digests(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def check_pack(lengths, capacity):
    got, room = pack(lengths, capacity), {}
    parts = {}
    for d, s, n, q, o in got:
        assert n > 0
        parts.setdefault(d, []).append((s, n))
        room.setdefault(q, []).append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(parts.get(d, [])):
            assert s == at
            at += k
        assert at == n
    for spans in room.values():
        at = 0
        for o, k in sorted(spans):
            assert o == at
            at += k
        assert at <= capacity
    assert len(room) == -(-sum(lengths) // capacity)


def test_packing():
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([1, 7, 16]))
    def whole(lengths, capacity):
        check_pack(lengths, capacity)

    whole()


def test_packing_frames(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["of", "the", "thand", "é"]) for _ in range(rng.choice([1, 30, 900])))) for i in range(60)] + [(7, "again"), (99, None), (98, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = pack_documents(df, P.path("byte_bpe_50k.json"), capacity=64, shard_tokens=500).collect()
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((d, [*plain.encode(t or "").ids, 0]) for d, t in docs if d != 7)
    for d, x in want:
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(x) == mine[0]["doc_tokens"]
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for q in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == q), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert pack_documents(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_elias_fano():
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.integers(0, 1 << 40), max_size=700))
    def same(values):
        values.sort()
        ef, _ = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
        assert ef.values().tolist() == values
        for i in range(0, len(values), 37):
            assert ef.select(i) == values[i] and ef.select_range(i, min(len(values), i + 300)).tolist() == values[i : i + 300]

    same()
    many = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(EliasFano.of(many).to_bytes()) < 50_000 * 2


def test_segments():
    s = Segment(encode_segment([None, -5, 3, 3, 1 << 40], [np.array(x, "<u4").tobytes() for x in ([], [1], [70000, 2], [3], [])]))
    assert s.doc_ids(0, 5) == [None, -5, 3, 3, 1 << 40] and s.doc_ids(1, 3) == [-5, 3]
    for lo, hi in ((0, 5), (1, 4), (3, 5)):
        starts, got = s.documents(lo, hi)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[], [1], [70000, 2], [3], []][lo:hi] and starts.tolist() == [0, 0, 1, 3, 4][lo:hi]
    assert [s.document(i).tolist() for i in range(5)] == [[], [1], [70000, 2], [3], []]


def test_token_files(spark, tmp_path):
    docs = [(i * 3 % 50, f"Word{i} and, more." if i % 5 else None) for i in range(50)] + [(4, "again"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    path = P.path("word_bpe_49k.json")
    write_token_files(df, str(tmp_path / "a"), path, end_id=2, segment_ids=20)
    got = sorted(digests(read_token_files(spark, str(tmp_path / "a"))).collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_file(path)
    encoded = sorted(((-1 if d is None else d), np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in docs)
    at = 0
    for r, (d, x) in zip(got, encoded, strict=True):
        assert (-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(x) // 4, zlib.crc32(x))
        at += len(x) // 4
    write_token_files(df.limit(0), str(tmp_path / "b"), path, end_id=2)
    assert read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(6)
    long = " ".join(rng.choice(["of", "the", "thand", "é", "Water,", "<|endoftext|>", "12"]) + str(rng.randrange(100)) for _ in range(60_000))
    df = spark.createDataFrame([(2, long, "x"), (1, "short", "y"), (3, None, "z")], "doc_id long, text string, ids string")
    plain, words = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = np.array([*plain.encode(long, add_special_tokens=False).ids, 0], "<u4")
    pieces = sorted((r for r in pack_documents(df, P.path("byte_bpe_50k.json")).collect() if r["doc_id"] == 2), key=lambda r: r["start"])
    assert sum(r["length"] for r in pieces) == len(want) and all(r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    write_token_files(df, str(tmp_path / "a"), P.path("word_bpe_49k.json"), end_id=2)
    got = {r["doc_id"]: r for r in digests(read_token_files(spark, str(tmp_path / "a"))).collect()}
    ids = np.array([*words.encode(long, add_special_tokens=False).ids, 2], "<u4")
    assert (got[2]["n_tokens"], got[2]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    codec = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = {r["doc_id"]: r for r in encode_decode(df, P.path("piece_bpe_32k.model")).collect()}
    assert rows[2]["ids"] == [*codec.encode(long), 2] and rows[2]["decoded"] == codec.decode(rows[2]["ids"])


def brute_pack(lengths, capacity):
    """The rule in plain steps: whole sequences first; then rests, longest first, to the cheapest sequence with room, or what fits to the roomiest."""
    out, rests, used = [], [], 0
    for d, n in enumerate(lengths):
        for s in range(0, n // capacity * capacity, capacity):
            out.append((d, s, capacity, used, 0))
            used += 1
        if n % capacity:
            rests.append((d, n // capacity * capacity, n % capacity))
    bins = [[0, 0.0] for _ in range(-(-sum(r[2] for r in rests) // capacity))]
    while rests:
        rests.sort(key=lambda r: (-r[2], r[0]))
        d, s, n = rests.pop(0)
        fits = [i for i, (size, _) in enumerate(bins) if size + n <= capacity]
        if fits:
            i = min(fits, key=lambda i: (bins[i][1], i))
            take = n
        else:
            i = min(range(len(bins)), key=lambda i: (bins[i][0], i))
            take = capacity - bins[i][0]
            rests.append((d, s + take, n - take))
        out.append((d, s, take, used + i, bins[i][0]))
        bins[i][0] += take
        bins[i][1] += take + take * take / 1024
    return out


def test_packing_keeps_its_rule():
    rng = random.Random(9)
    for capacity in (7, 16, 64):
        for _ in range(40):
            lengths = [rng.randint(1, rng.choice([3, capacity, 3 * capacity])) for _ in range(rng.randint(0, 40))]
            assert sorted(pack(lengths, capacity)) == sorted(brute_pack(lengths, capacity))
