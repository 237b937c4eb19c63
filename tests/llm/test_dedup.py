import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from rangewarden.llm.components import components
from rangewarden.llm.doubling import repeated_windows
from rangewarden.llm.embedding_dedup import embedding_groups
from rangewarden.llm.exact_dedup import exact_dedup, exact_groups
from rangewarden.llm.simhash import _FIRSTS, fingerprint, group_pairs, in_parts, linked, matches, near_duplicates, near_pairs, near_texts, near_words, pairs_of_groups, parities, parities_allow, shingle_hashes, simhash_groups
from rangewarden.llm.suffix_dedup import BLOCK, without_repeats

WORDS = "of the and thing ontion reble ere wh st Of and, THE ét é ß".split()


def texts(n, seed, longest=60):
    """Texts with copies, near copies, shared passages, repeated lines, nulls and blanks."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) + rng.choice(["", "x", "yé", "zz", "q"]) + rng.choice("abcdefgh")
    passages = [" ".join(word() for _ in range(20)) for _ in range(4)]
    out = [None, "", "   ", "\n", "one", "one two three", "ONE", "x" * 200, "x" * 210]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.15:
            out.append(rng.choice(out))
        elif kind < 0.3 and (old := rng.choice(out)):
            ws = old.split(" ")
            ws[rng.randrange(len(ws))] = word()
            out.append(" ".join(ws))
        elif kind < 0.5:
            out.append(" ".join([word() for _ in range(5)] + [rng.choice(passages)] + [word() for _ in range(rng.randint(0, 20))]))
        elif kind < 0.55:
            out.append("again. " * rng.randint(5, 40))
        else:
            out.append(" ".join(word() for _ in range(rng.randint(1, longest))))
    rng.shuffle(out)
    return out


def frame(spark, found, parts=3):
    rows = [(i * 7 % 1000, t, f"s{i}", i) for i, t in enumerate(found)] + [(None, "no id here", "s", 0), (3, "another of id three", "s", 1), (3, "another of id three", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n long").repartition(parts), rows


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("largest", [False, True])
def test_exact(spark, largest):
    df, rows = frame(spark, texts(150, 1))
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(lower(t), []).append(d)
    got = exact_groups(df, keep_largest=largest).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        known = [d for d in ids if d is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == ((max if largest else min)(known) if known else None)
    assert sum(r["kept"] for r in got) == len(groups) == exact_dedup(df, largest).count()
    assert exact_dedup(df).columns == df.columns and exact_groups(df.limit(0)).count() == 0


def brute_fingerprint(t, k):
    ws = [w for w in re.split(rb"[\x20\x09-\x0d]+", lower(t)) if w]
    runs = [b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, pairs):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark):
    df, rows = frame(spark, texts(120, 2))
    fps = [brute_fingerprint(r[1], 4) for r in rows]
    for (_, t, *_), f in zip(rows, fps, strict=True):
        assert fingerprint(shingle_hashes(t or "", 4)) == f
    comp = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted((str(r[0]), f"{f:016x}", str(least[c])) for r, f, c in zip(rows, fps, comp, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash_groups(df, 4, 4).collect()) == want
    assert simhash_groups(df.limit(0), 4, 4).count() == 0


def test_strips_of_tiles_miss_no_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(k)) ^ np.uint64(1 << int(j)) for k, j in rng.integers(0, 62, (4, 2)))])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps.view(np.uint64)[i] ^ fps.view(np.uint64)[j]).bit_count() <= 3])
    for tile, together in ((3, 4), (50, 1), (8192, 64)):
        place = {int(x): i for i, x in enumerate(fps)}
        got = [(place[r["a"]], place[r["b"]]) for r in near_pairs(df, 3, tile, together).collect()]
        assert roots(len(fps), got) == want


def test_long_texts_have_their_fingerprint(spark):
    rng = random.Random(6)
    long = " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**4)}" for _ in range(70_000))  # more shingles than are counted at once
    (r,) = simhash_groups(spark.createDataFrame([(1, long, "x")], "doc_id long, text string, fp string"), 4, 4).collect()
    assert r["fingerprint"] == f"{brute_fingerprint(long, 4):016x}"


def test_linked_in_blocks():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    a = np.concatenate([base ^ np.uint64(1 << k) for k in range(5)])
    edges = linked(a, a, 3, True)
    pairs = [(i, j) for i in range(len(a)) for j in range(i) if int(a[i] ^ a[j]).bit_count() <= 3]
    assert roots(len(a), edges.tolist()) == roots(len(a), pairs)


def brute_near(rows, words=5, similarity=0.8):
    """(doc_id, shingles) of what stays: the first document of each group of linked texts."""
    last = 1 << 63
    sets = {(last if d is None else d, t): frozenset(shingle_hashes(t or "", words)) for d, t, *_ in rows}
    places = sorted(sets, key=lambda x: (x[0], x[1] or ""))
    like = lambda a, b: len(a & b) >= similarity * len(a | b)
    comp = roots(len(places), [(i, j) for i in range(len(places)) for j in range(i) if like(sets[places[i]], sets[places[j]])])
    return sorted(str((places[c][0], sorted(sets[places[c]]))) for c in set(comp))


def kept_near(df, **how):
    last = 1 << 63
    return sorted({str((last if r["doc_id"] is None else r["doc_id"], sorted(set(shingle_hashes(r["text"] or "", 5))))) for r in near_duplicates(df, **how).collect()})


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates(spark, seed):
    df, rows = frame(spark, texts(200, seed, 200))
    assert kept_near(df) == brute_near(rows)
    assert near_duplicates(df).columns == df.columns and near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_beyond_the_radius(spark):
    rng = random.Random(8)
    found = []
    for _ in range(80):  # one inner word of 50 changed: 41 of 51 shingles, often beyond 12 bits
        ws = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(50)]
        found += [" ".join(ws), " ".join(w if i != 25 else "other" for i, w in enumerate(ws))]
    df, rows = frame(spark, found + texts(150, 7, 200))
    assert any((brute_fingerprint(found[i], 5) ^ brute_fingerprint(found[i + 1], 5)).bit_count() > 12 for i in range(0, 160, 2))
    assert kept_near(df) == brute_near(rows)


@pytest.mark.parametrize("radius", [12, 24, 64])
def test_near_duplicates_in_large_groups(spark, radius):
    rng = random.Random(9)
    ws = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    found = []
    for _ in range(300):  # all share words, and are near a common middle, so that many are linked by others only
        own = [*ws]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        found.append(" ".join(own))
    df, rows = frame(spark, found)
    assert kept_near(df, radius=radius) == brute_near(rows)


def test_parities_keep_similar_sets():
    rng = np.random.default_rng(5)
    far = 0
    for n in [*range(1, 40), 63, 64, 65, 500, 1030, 3000]:
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for k in range(0, n // 4 + 1, max(1, n // 40)):
            y = np.unique(np.r_[x[k:], rng.integers(0, 1 << 63, k // 3, dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            if both >= 0.8 * (len(x) + len(y) - both):
                assert parities_allow(parities(x), len(x), parities(y), len(y), 0.8), (n, k)
        y = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        far += parities_allow(parities(x), n, parities(y), n, 0.8)
    assert far == 0 and parities_allow(parities(x[:0]), 0, parities(x[:0]), 0, 0.8)


def test_group_pairs_links_large_groups():
    rng = np.random.default_rng(3)
    rows = np.zeros(300, _FIRSTS)
    rows["key"], rows["n"], rows["fp"] = np.arange(300), np.r_[np.full(200, 50), np.full(100, 90)], rng.integers(0, 1 << 63, 10, dtype=np.uint64)[rng.integers(0, 10, 300)]
    want = [(i, j) for i in range(300) for j in range(i) if rows["n"][i] == rows["n"][j]]
    pairs = group_pairs(rows, 3, 0.8)
    near = [(p["a"], p["b"]) for p in pairs if p["tree"]]
    assert len(near) == 280 and all(rows["fp"][a] == rows["fp"][b] and rows["n"][a] == rows["n"][b] for a, b in near)
    joined = roots(300, near)
    got = {(p["b"], p["a"]) for p in pairs}
    assert {(i, j) for i, j in want if joined[i] != joined[j]} <= got <= set(want) and len(got) < len(want)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(600, pairs)
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, size=50):
    first = {}
    last = 1 << 63
    for d, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            first[w] = min(first.get(w, last), last - 1 if d is None else d)
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < (last - 1 if d is None else d):
                gone[s : s + size] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        yield str(d), bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), int(gone.sum()), runs


@pytest.mark.parametrize("seed", [5, 6])
def test_repeats(spark, seed):
    df, rows = frame(spark, texts(130, seed))
    got = without_repeats(df, "row", "n")
    assert got.columns == ["doc_id", "row", "n", "left", "n_bytes", "n_removed", "n_spans"]
    assert sorted((str(r["doc_id"]), bytes(r["left"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()) == sorted(brute_repeats(rows))
    assert without_repeats(df.limit(0)).count() == 0


def test_repeats_of_many_null_ids(spark):
    rng = random.Random(11)
    line = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = [line(70) for _ in range(20)]
    rows = [(i, line(30) + p) for i, p in enumerate(shared)] + [(None if i % 3 else 7, line(rng.randint(1, 60)) + rng.choice([*shared, ""]) + line(rng.randint(0, 60))) for i in range(4000)]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), bytes(r["left"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == sorted(brute_repeats(rows))


def test_plain_doubling_finds_the_same(spark):
    df, rows = frame(spark, [t for t in texts(60, 12, 40) if t] + ["x" * 120, "y" * 49, "y" * 50, "y" * 51])
    keyed = df.where("doc_id IS NOT NULL").selectExpr("doc_id AS doc", "xxhash64(cast(text AS binary)) AS tag", "cast(coalesce(text, '') AS binary) AS body")
    first = {}
    known = [(d, (t or "").encode()) for d, t, *_ in rows if d is not None]
    for d, b in known:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], d), d)
    want = sorted({(d, s) for d, b in known for s in range(len(b) - 49) if first[b[s : s + 50]] < d})
    assert want and sorted({(r["doc"], r["at"]) for r in repeated_windows(keyed).collect()}) == want


def test_long_texts_lose_what_repeats(spark):
    rng = random.Random(13)
    line = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    shared = line(300)
    long = line(BLOCK // 2) + shared + line(BLOCK // 2) + shared + line(40)  # more windows than are looked at at once
    got = {r["doc_id"]: r for r in without_repeats(spark.createDataFrame([(1, "head#" + shared), (2, long)], "doc_id long, text string")).collect()}
    assert (got[2]["n_bytes"], got[2]["n_removed"], got[2]["n_spans"]) == (len(long), 600, 2) and bytes(got[2]["left"]) == long.replace(shared, "").encode()


def test_embeddings_at_the_default_target(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(800, 24))
    near = base[rng.integers(0, 800, 1600)] + rng.normal(size=(1600, 24)) * rng.choice([0.02, 0.05, 0.065], size=(1600, 1))
    x = np.concatenate([base, near]).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in embedding_groups(df, cell=40).collect()}
    assert all(got[i] <= n for i, n in enumerate(links)) and sum(got.values()) >= 0.99 * links.sum() > 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 60, 150)] + rng.normal(size=(150, 16)) * 0.04
    vectors = [*base.tolist(), *near.tolist(), *([base[0].tolist()] * 20), (base[1] * 3).tolist(), [0.0] * 16, None, [], [float("nan")] * 16, [1.0] * 3, [2.0] * 3, [None] * 16, [1e30] * 16]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string").repartition(3)
    got = {r["vec_id"]: r for r in embedding_groups(df, cell=20, block=7, target=1.0).collect()}
    x = [None if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, np.float32).astype(np.float64) for v in vectors]
    link = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if link(x[i], x[j])]
    comp = roots(len(x), pairs)
    n = np.zeros(len(x), int)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    assert {k: (r["n_links"], r["component_id"], r["kept"]) for k, r in got.items()} == {i: (n[i], comp[i], comp[i] == i) for i in range(len(x))}
    assert embedding_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 12])
def test_tiles_find_each_pair_and_compare_few(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 3), replace=False)) for _ in base], dtype=np.uint64)
    a, b = base, base ^ flips
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None]) <= radius), strict=True)}
    assert {(x, y) for i, j in near_words(a, b, radius) for x, y in zip(i, j, strict=True)} == want and len(want) > 100
    same = np.repeat(base[:3], 200)  # all are near: comparing all is less work
    assert sum(len(i) for i, _ in near_words(same, same, radius)) >= 3 * 200 * 200
    # Of words at random, tiles at radius 4 match less than a hundredth.
    tried = sum(int((begins[1:] - begins[:-1]).astype(float) @ (begins[1:] - begins[:-1])) for _, _, _, begins in matches(a, radius))
    assert tried < 0.01 * len(a) ** 2 + (radius + 1) * len(a) * 2 or radius > 4


def test_pairs_of_large_groups_come_in_parts():
    rng = np.random.default_rng(6)
    rows = np.zeros(3000, _FIRSTS)
    rows["key"], rows["n"], rows["fp"] = np.arange(3000), 50, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)  # unrelated texts with a common hash
    tracemalloc.start()
    n = sum(len(part) for part in in_parts(pairs_of_groups(rows, 3, 0.8)))
    assert n == 3000 * 2999 // 2 and tracemalloc.get_traced_memory()[1] < 80e6  # all pairs at once take 112 MB, and several times that with their copies
    tracemalloc.stop()


@pytest.mark.parametrize(("tile", "together"), [(8192, 8), (10, 2), (7, 1)])
def test_texts_meet_the_nearest_by_fingerprint_in_tiles(spark, tile, together):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base ^ np.uint64(sum(1 << int(k) for k in rng.choice(62, 4, replace=False))) for _ in range(8)])
    known = spark.createDataFrame([(i, int(f.view(np.int64)), 50 + i % 12) for i, f in enumerate(fps)], "key long, fp long, n int")
    want = {(i, j) for j in range(len(fps)) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= 12}
    got = {(r["a"], r["b"]) for r in near_texts(known, 12, 0.8, tile, together).collect()}
    assert got <= want and roots(len(fps), got) == roots(len(fps), want)
