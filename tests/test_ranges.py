import random

from rangewarden import queries
from rangewarden.functions.ipcalc import format_cidr, parse_cidr
from rangewarden.operators import ranges
from rangewarden.plans.static import merge

#: Fixed values (FIXTURES.md): ranges and what is left of them, merged or less a whitelist.
MERGES = [
    ("192.168.1.2/32 192.168.1.3/32", "192.168.1.2/31"),
    ("10.0.0.0/24 10.0.0.128/25", "10.0.0.0/24"),
    ("172.16.0.0/24 172.16.1.0/24", "172.16.0.0/23"),
    ("192.168.0.0/24 192.168.1.0/24 192.168.2.0/24 192.168.3.0/24", "192.168.0.0/22"),
    ("10.0.0.0/24 10.0.1.0/24 10.0.2.0/24", "10.0.0.0/23 10.0.2.0/24"),
    ("192.168.1.0/25 192.168.1.128/25 192.168.2.0/24", "192.168.1.0/24 192.168.2.0/24"),
    ("10.0.0.0/8 10.0.0.0/9", "10.0.0.0/8"),
    ("192.168.1.0/24 10.0.0.0/24", "10.0.0.0/24 192.168.1.0/24"),
    ("10.0.0.0/24 10.0.1.0/25 10.0.1.128/26 10.0.1.192/26", "10.0.0.0/24 10.0.1.0/24"),
]
CUTS = [
    ("10.0.0.0/8", "not-a-cidr 999.1.2.3/8", "10.0.0.0/8"),
    ("garbage", "10.0.0.0/8", "garbage"),
    ("10.1.0.0/16", "10.0.0.0/8", ""),
    ("10.0.1.0/24", "10.0.0.0/25", "10.0.1.0/24"),
    ("10.0.1.0/24", "10.0.1.64/26", "10.0.1.0/26 10.0.1.128/25"),
    ("10.0.0.0/24", "10.0.0.64/26 10.0.0.128/26", "10.0.0.0/26 10.0.0.192/26"),
    ("255.255.255.0/24", "255.255.255.128/25", "255.255.255.0/25"),
    ("0.0.0.0/0", "0.0.0.0/0", ""),
    ("192.168.1.0/24", "192.168.1.201/32", "192.168.1.0/25 192.168.1.128/26 192.168.1.192/29 192.168.1.200/32 192.168.1.202/31 192.168.1.204/30 192.168.1.208/28 192.168.1.224/27"),
    ("192.0.2.5/24", "10.0.0.0/8", "192.0.2.5/24"),
]


def bounds(text):
    return [(b[0], b[2]) for b in map(parse_cidr, text.split())]


def texts(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "ord long, cidr string")


def test_merges(spark):
    rows = [(i, *b) for i, (x, _) in enumerate(MERGES) for b in bounds(x)]
    got = ranges.merge_ranges(spark.createDataFrame(rows, "k int, start long, len int"), "k").collect()
    for i, (x, want) in enumerate(MERGES):
        assert sorted((r["start"], r["len"]) for r in got if r["k"] == i) == sorted(bounds(want))
        assert merge(bounds(x)) == sorted(bounds(want))


def test_cover_of_every_address(spark, monkeypatch):
    rng = random.Random(12)
    ips = sorted({rng.randrange(1, 1 << 32) for _ in range(80)} | {1, 49, 50, 999, (1 << 32) - 1, 4294967000})
    monkeypatch.setattr(queries, "counts", lambda s, d: s.createDataFrame([(x, 1) for x in ips], "ip long, cnt long"))
    want = []
    for ip in ips:
        at, end = ip, ip + ip % 1000
        while at <= end < 1 << 32:
            bits = max(k for k in range(33) if at % (1 << k) == 0 and at + (1 << k) - 1 <= end)
            want.append((ip, at, 32 - bits))
            at += 1 << bits
    got = queries.queries()["interval_cover"](spark, "").collect()
    assert sorted((r["ip"], r["start"], r["len"]) for r in got) == sorted(want)
    assert any(ip % 50 for ip, *_ in want)


def test_subtraction(spark):
    for black, white, want in CUTS:
        got = ranges.remove_whitelisted(texts(spark, [black]), texts(spark, white.split())).collect()
        assert sorted(r["cidr"] for r in got) == sorted(want.split()), (black, white)


def test_empty_lists(spark):
    none, some = texts(spark, []), texts(spark, ["10.0.0.0/8", "x"])
    assert ranges.remove_whitelisted(none, some).count() == 0
    assert sorted(r["cidr"] for r in ranges.remove_whitelisted(some, none).collect()) == ["10.0.0.0/8", "x"]
    assert ranges.drop_fully_whitelisted(some, none).count() == 2


def test_cover_is_greedy_and_minimal(spark):
    rng = random.Random(5)
    cases = [(5, 4), (0, 0), (2**32 - 1, 2**32 - 1), (0, 2**32 - 1)] + [tuple(sorted(rng.randrange(1 << rng.choice([8, 20, 32])) for _ in range(2))) for _ in range(200)]
    got = ranges.cover(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k int, start long, end long")).collect()
    for i, (s, e) in enumerate(cases):
        want = []
        while s <= e:
            size = 1
            while s % (2 * size) == 0 and s + 2 * size - 1 <= e and size < 1 << 32:
                size *= 2
            want.append((s, 33 - size.bit_length()))
            s += size
        assert sorted((r["start"], r["len"]) for r in got if r["k"] == i) == want


def test_published_ranges_never_hold_whitelisted_addresses(spark):
    rng = random.Random(8)
    some = lambda n, lo: [format_cidr(rng.randrange(1 << 16) << 16 >> (32 - k) << (32 - k), k) for k in (rng.randint(lo, 32) for _ in range(n))]
    black, white = some(40, 6), some(60, 10)
    left = [parse_cidr(r["cidr"]) for r in ranges.compose_ban_lists(texts(spark, black), texts(spark, black[:5]), texts(spark, white)).collect()]
    for w in map(parse_cidr, white):
        assert not any(b[0] <= w[1] and w[0] <= b[1] for b in left)


def test_union_joins_neighbours(spark):
    got = ranges.interval_union(spark.createDataFrame([(0, 9), (10, 12), (14, 15), (3, 4)], "start long, end long")).collect()
    assert sorted(map(tuple, got)) == [(0, 12), (14, 15)]


def random_ranges(rng, n, least, most, spread=32):
    return sorted({(rng.randrange(1 << min(k, spread)) << (32 - k), k) for k in (rng.randint(least, most) for _ in range(n))})


def test_merging_blocks_is_merging_all(spark):
    rng = random.Random(3)
    cases = [random_ranges(rng, n, lo, hi) for n, lo, hi in [(30, 5, 10), (60, 7, 10), (200, 8, 10), (300, 8, 9), (40, 1, 9), (500, 9, 11)] for _ in range(6)]
    cases += [[(a << 24, 8) for a in range(256)], [(a << 23, 9) for a in range(512)], [(a << 22, 10) for a in range(1024)], [(a << 23, 9) for a in range(2)] + [(a << 24, 8) for a in range(1, 4)]]
    rows = [(i, *r) for i, x in enumerate(cases) for r in x]
    got = ranges.merge_ranges(spark.createDataFrame(rows, "k int, start long, len int"), "k").collect()
    for i, x in enumerate(cases):
        assert sorted((r["start"], r["len"]) for r in got if r["k"] == i) == sorted(merge(x)), i
    (one,) = (c for c in cases if len(c) == 512)
    assert sorted(map(tuple, ranges.merge_ranges(spark.createDataFrame(one, "start long, len int")).collect())) == sorted(merge(one))


def test_outermost_and_union_across_blocks(spark):
    rng = random.Random(4)
    found = random_ranges(rng, 150, 3, 12) + random_ranges(rng, 150, 12, 30, 14) * 2
    df = spark.createDataFrame(found, "start long, len int")
    size = lambda n: 1 << (32 - n)
    want = {(s, n) for s, n in found if not any((s, n) != (a, m) and a <= s and s + size(n) <= a + size(m) for a, m in found)}
    assert sorted(map(tuple, ranges.remove_contained(df).collect())) == sorted(want)
    spans = [(s, min((1 << 32) - 1, s + rng.choice([0, 5, 1 << 20, 1 << 26]))) for s, _ in found] + [(0, 3 << 24), ((3 << 24) + 1, 4 << 24)]
    joined = []
    for s, e in sorted(spans):
        if joined and s <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    assert sorted(map(list, ranges.interval_union(spark.createDataFrame(spans, "start long, end long")).collect())) == joined
