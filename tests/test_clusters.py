import random

import pytest

from rangewarden.functions.ipcalc import format_cidr, parse_ip
from rangewarden.operators.clusters import ClusterSet, detect

B = "192.168.1."
GOLDENS = [
    ([(B + "1", 1)], (1, 16, 31, 0.1), ["192.168.1.0/31"]),
    ([(B + "0", 1), (B + "1", 1)], (2, 24, 31, 0.1), ["192.168.1.0/31"]),
    ([(B + str(i), 1) for i in range(4)], (4, 24, 30, 0.1), ["192.168.1.0/30"]),
    ([(B + "0", 1), (B + "1", 1)], (3, 16, 32, 0.1), []),
    ([(B + "1", 3)], (3, 16, 32, 0.1), ["192.168.1.1/32"]),
    ([(B + str(i), 1) for i in range(5)], (5, 24, 30, 2.0), ["192.168.1.0/29"]),
    ([(B + "0", 2), (B + "1", 1)], (2, 24, 32, 0.0), ["192.168.1.0/32"]),
    ([(B + "0", 2), (B + "1", 2)], (4, 24, 32, 0.0), ["192.168.1.0/31"]),
    ([(B + "0", 3), (B + "1", 1)], (3, 24, 32, 1.0), ["192.168.1.0/32"]),
    ([(B + "0", 3), (B + "1", 2)], (5, 24, 32, 1.0), ["192.168.1.0/31"]),
    ([("0.0.0.1", 2), ("64.0.0.1", 1)], (3, 0, 32, 1e6), ["0.0.0.0/1"]),
    ([(B + "0", 2), (B + "1", 1)], (2, 24, 32, -1.0), ["192.168.1.0/32"]),
    ([], (0, 0, 32, 0.0), []),
    ([(B + "1", 1)], (1, 32, 32, 0.0), ["192.168.1.1/32"]),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ip long, cnt long")


@pytest.mark.parametrize("case", range(len(GOLDENS)))
def test_goldens(spark, case):
    ips, args, expected = GOLDENS[case]
    got = detect(frame(spark, [(parse_ip(a), n) for a, n in ips]), [ClusterSet(*args)]).collect()
    assert sorted(format_cidr(r["start"], r["len"]) for r in got) == expected


def test_large_counts_do_not_overflow(spark):
    got = detect(frame(spark, [(1, 2147485), (1 << 30, 1)]), [ClusterSet(1, 0, 32, 0.001)]).collect()
    assert "0.0.0.0/1" not in [format_cidr(r["start"], r["len"]) for r in got]


def walk(counts, s, depth=0, prefix=0):
    """The recursive reading of the rules."""
    inside = {ip: n for ip, n in counts.items() if ip >> (32 - depth) == prefix} if depth else counts
    if not inside:
        return []
    n = sum(inside.values()) if depth else 0
    if depth == s.max_depth:
        return [(prefix << (32 - depth), depth)] if n >= s.min_size else []
    left = sum(c for ip, c in inside.items() if not ip >> (31 - depth) & 1)
    right = sum(inside.values()) - left
    if left and right and (left == right or 2000 * abs(left - right) < s.milli * n) and n >= s.min_size and depth >= s.min_depth:
        return [(prefix << (32 - depth), depth)]
    return [x for b, c in ((0, left), (1, right)) if c and c >= s.min_size for x in walk(inside, s, depth + 1, prefix * 2 + b)]


def test_random_against_recursion(spark):
    rng = random.Random(3)
    for _ in range(6):
        base = rng.randrange(1 << 32) & ~0xFF
        counts = {base + rng.randrange(64): rng.randint(1, 5) for _ in range(rng.randint(1, 40))} | {rng.randrange(1, 1 << 32): 1 for _ in range(5)}
        sets = [ClusterSet(rng.randint(0, 8), lo := rng.randint(0, 28), rng.randint(lo, 32), rng.choice([0.0, 0.2, 1.0, 1.9])) for _ in range(4)]
        got = detect(frame(spark, list(counts.items())), sets).collect()
        for i, s in enumerate(sets):
            assert sorted((r["start"], r["len"]) for r in got if r["set_id"] == i) == sorted(walk(counts, s)), s
