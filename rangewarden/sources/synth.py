"""SRC-14, 15: invented logs and addresses, the same for the same seed."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import long_to_ip, parse_cidr

#: The format of the lines: combined, with the address first and once more at the end.
FORMAT = '%h %^ %^ [%t] "%r" %s %b "%^" "%u" "%^"'

#: The hot /16 networks, user agents and statuses with their shares of all lines, and the bounds of sizes, endpoints and times.
HOT = {
    "23.253.0.0/16": 0.01988,
    "143.173.0.0/16": 0.01788,
    "183.77.0.0/16": 0.01688,
    "87.26.0.0/16": 0.01683,
    "166.94.0.0/16": 0.01399,
    "50.231.0.0/16": 0.01331,
    "35.217.0.0/16": 0.01274,
    "154.29.0.0/16": 0.01022,
    "56.110.0.0/16": 0.00889,
    "129.94.0.0/16": 0.00845,
}
AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36": 0.2518,
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15": 0.1552,
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0": 0.1165,
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Mobile/15E148": 0.0953,
    "Mozilla/5.0 (Linux; Android 13) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0 Mobile Safari/537.36": 0.0816,
    "curl/8.4.0": 0.0718,
    "python-requests/2.31.0": 0.0648,
    "Anubis-OGTag-Fetcher/1.0": 0.0586,
    "Googlebot/2.1 (+http://www.google.com/bot.html)": 0.0539,
    "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)": 0.0505,
}
STATUSES = {"200": 0.60, "301": 0.10, "304": 0.10, "404": 0.10, "500": 0.10}
ENDPOINTS, ZIPF, BYTES = 100, 1.1, (1800, 8800)
START, SPAN_SECONDS, JITTER_SECONDS = 1770162984, 72 * 3600, 300
#: Addresses of no background traffic, besides what lies outside 1.0.0.0 to 223.255.255.255.
RESERVED = ("10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")


def _draw(seed: int, what: int) -> Column:
    """A number from 0 to 1, without 1, from the line's number."""
    return F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(what)), 11) / F.lit(float(1 << 53))


def _below(seed: int, what: int, n: int) -> Column:
    return F.floor(_draw(seed, what) * n).cast("long")


def _pick(values: dict, share: Column) -> Column:
    """The value whose part of the weights, one after another, holds the share."""
    out = None
    for value, upto in zip(values, accumulate(values.values())):
        hit = F.lit(value)
        out = F.when(share < upto, hit) if out is None else out.when(share < upto, hit)
    return out


def _background(seed: int) -> Column:
    """An address from 1.0.0.0 to 223.255.255.255 outside the reserved ranges, all alike: the place among those that are left."""
    taken = sorted((b[0], b[1]) for b in map(parse_cidr, RESERVED))
    low, high = 1 << 24, (224 << 24) - 1
    place = low + _below(seed, 2, high - low + 1 - sum(e - s + 1 for s, e in taken))
    for s, e in taken:  # in order, each one met shifts what lies behind it
        place = F.when(place >= s, place + (e - s + 1)).otherwise(place)
    return place


def synthetic_log(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n log lines (value): hot networks, user agents, endpoints of Zipf's law, times that ascend with some jitter."""
    share = _draw(seed, 1)
    hot = _pick({parse_cidr(k)[0]: w for k, w in HOT.items()}, share)
    ip = F.coalesce(hot + _below(seed, 3, 1 << 16), _background(seed))
    ranks = {k: k**-ZIPF for k in range(1, ENDPOINTS + 1)}
    offset = F.greatest(F.lit(0.0), F.col("id") * (SPAN_SECONDS / n) + (_draw(seed, 4) * 2 - 1) * JITTER_SECONDS)
    time = F.timestamp_seconds(F.lit(START) + F.floor(offset))
    text = long_to_ip(F.col("ip"))
    line = F.concat(
        text, F.lit(" - - ["), F.date_format(time, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /fake-endpoint-'), _pick(ranks, _draw(seed, 5) * sum(ranks.values())).cast("string"),
        F.when(_draw(seed, 6) < 0.5, " HTTP/1.0").otherwise(" HTTP/1.1"), F.lit('" '), _pick(STATUSES, _draw(seed, 7) * sum(STATUSES.values())), F.lit(" "), (BYTES[0] + _below(seed, 8, BYTES[1] - BYTES[0] + 1)).cast("string"),
        F.lit(' "-" "'), _pick(AGENTS, _draw(seed, 9) * sum(AGENTS.values())), F.lit('" "'), text, F.lit('"'),
    )
    return spark.range(n).select("id", ip.alias("ip")).select(line.alias("value"))


def random_addresses(spark: SparkSession, cidr: str, n: int, seed: int = 1) -> DataFrame:
    """n addresses (ip) of a range, without its first and last one where it has others."""
    bounds = parse_cidr(cidr)
    if bounds is None:
        raise ValueError(f"{cidr!r} is not an IPv4 range")
    start, end, _ = bounds
    inner = end - start - 1
    return spark.range(n).select((F.lit(start).cast("long") + (1 + _below(seed, 1, inner) if inner > 0 else _below(seed, 1, end - start + 1))).alias("ip"))
