"""Queries over the driver's tables, and the same in SQL for DuckDB.

The tables have no access logs, so `req` derives one from events by integer arithmetic, and log lines
are built from it. 10.20.0.0/20 and 203.0.113.0/26 are its hot spots.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.functions import ipcalc
from rangewarden.functions.regexes import matches
from rangewarden.operators import clusters, filters, grids, jail, prefixes, ranges, windows
from rangewarden.operators.clusters import ClusterSet
from rangewarden.sources import logformat, readers, synth

COARSE, STANDARD, DEEP = ClusterSet(100, 8, 16, 0.5), ClusterSet(100, 16, 28, 0.2), ClusterSet(20, 20, 32, 0.9)
WHITE = ["10.20.1.0/24", "10.20.8.0/25", "10.20.8.128/25", "203.0.113.16/28", "198.51.100.0/24"]
BLACK = ["10.20.0.0/20", "203.0.113.0/26", "10.20.8.0/24", "198.51.100.7/32", "192.0.2.5/24", "not-a-range", "0.0.0.0/8"]
RANGES = ["10.20.0.0/16", "203.0.113.0/26", "10.20.4.0/22", "192.168.0.0/16", "0.0.0.0/1"]


def req(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "event_id", "ts AS wall_ts", "cast((event_id % 3 - 1) * 3600 AS int) AS offset_sec", "user_id",
        """CASE WHEN event_id % 97 = 0 THEN 0L WHEN event_id % 5 = 0 THEN 169082880L + (event_id * 7919) % 4096
                WHEN event_id % 5 = 1 THEN 3405803776L + event_id % 64 ELSE (event_id * 2654435761L) % 4294967296L END AS ip""",
        "concat('/', event_type, '/', cast(user_id % 10 AS string)) AS uri", "event_type AS user_agent",
    )


REQ = """req AS (
  SELECT event_id, ts AS wall_ts, CAST((event_id % 3 - 1) * 3600 AS INTEGER) AS offset_sec, user_id,
    CAST(CASE WHEN event_id % 97 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 169082880 + (event_id * 7919) % 4096
              WHEN event_id % 5 = 1 THEN 3405803776 + event_id % 64 ELSE (event_id * 2654435761) % 4294967296 END AS BIGINT) AS ip,
    concat('/', event_type, '/', CAST(user_id % 10 AS VARCHAR)) AS uri, event_type AS user_agent
  FROM events)"""
T = f"{REQ}, t AS (SELECT ip, count(*) AS cnt FROM req WHERE ip <> 0 GROUP BY ip)"


def counts(spark, sf_dir):
    return prefixes.address_counts(req(spark, sf_dir))


def _ip_sql(x: str) -> str:
    return f"concat_ws('.', (({x}) >> 24) & 255, (({x}) >> 16) & 255, (({x}) >> 8) & 255, ({x}) & 255)"


def _cluster_ctes(sets: list[ClusterSet], t: str = "t") -> str:
    values = ", ".join(f"({i}, {s.min_size}, {s.min_depth}, {s.max_depth}, {s.milli})" for i, s in enumerate(sets))
    lo, hi = min(s.min_depth for s in sets), max(s.max_depth for s in sets)
    return f"""sets(set_id, min_size, min_depth, max_depth, thr) AS (VALUES {values}),
n AS (SELECT d, ip >> (32 - d) AS p, CAST(sum(CASE WHEN d = 0 THEN 0 ELSE cnt END) AS BIGINT) AS cnt,
        CAST(sum(CASE WHEN d < 32 AND (ip >> (31 - least(d, 31))) & 1 = 0 THEN cnt ELSE 0 END) AS BIGINT) AS l,
        CAST(sum(CASE WHEN d < 32 AND (ip >> (31 - least(d, 31))) & 1 = 1 THEN cnt ELSE 0 END) AS BIGINT) AS r
      FROM {t}, range({lo}, {hi + 1}) g(d) GROUP BY d, ip >> (32 - d)),
c AS (SELECT set_id, min_depth, CAST(d AS INTEGER) AS len, p << (32 - d) AS start, (p << (32 - d)) + (1::BIGINT << (32 - d)) - 1 AS e, cnt
      FROM n, sets WHERE cnt >= min_size AND d BETWEEN min_depth AND max_depth
        AND (d = max_depth OR (l > 0 AND r > 0 AND (l = r OR 2000 * abs(l - r) < thr * cnt)))),
a AS (SELECT *, max(e) OVER (PARTITION BY set_id, start >> (32 - min_depth) ORDER BY start, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS me FROM c),
found AS (SELECT set_id, start, len, cnt FROM a WHERE me IS NULL OR me < e)"""


def _detect(sets):
    return lambda spark, d: clusters.detect(counts(spark, d), sets)


def _detect_sql(sets, t=T):
    return f"WITH {t}, {_cluster_ctes(sets)} SELECT * FROM found"


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, cidr string")


def _values(texts):
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(texts))


_PARSED = """(SELECT ord, cidr, start - start % size AS start, start - start % size + size - 1 AS e, len FROM (
  SELECT ord, cidr, len, CAST(split_part(cidr, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(cidr, '.', 2) AS BIGINT) * 65536 + CAST(split_part(cidr, '.', 3) AS BIGINT) * 256
    + CAST(split_part(split_part(cidr, '/', 1), '.', 4) AS BIGINT) AS start, 1::BIGINT << (32 - len) AS size
  FROM (SELECT ord, cidr, CAST(split_part(cidr, '/', 2) AS INTEGER) AS len FROM {0} WHERE regexp_full_match(cidr, '[0-9.]+/[0-9]+'))))"""


def _lists_sql(*more: str) -> str:
    return f"""WITH RECURSIVE bt(ord, cidr) AS (VALUES {_values(BLACK)}), wt(ord, cidr) AS (VALUES {_values(WHITE)}), b AS {_PARSED.format("bt")}, w AS {_PARSED.format("wt")}""" + "".join(f", {m}" for m in more)


#: Whole addresses that stay of each black range, cut into prefixes greedily: another way than the engine's.
_CUT_SQL = """, edges AS (SELECT b.ord, w.start AS s, w.e FROM b JOIN w ON b.start <= w.e AND w.start <= b.e UNION ALL SELECT ord, e + 1, e + 1 FROM b),
 walk AS (SELECT ord, s, e, max(e) OVER (PARTITION BY ord ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM edges),
 gaps AS (SELECT k.ord, coalesce(k.before + 1, b.start) AS s, k.s - 1 AS e FROM walk k JOIN b USING (ord) WHERE coalesce(k.before + 1, b.start) <= k.s - 1),
 cut AS (SELECT ord, s, e, CAST(NULL AS BIGINT) AS blk, CAST(NULL AS INTEGER) AS len FROM gaps
   UNION ALL SELECT ord, s + size, e, s, CAST(32 - bits AS INTEGER) FROM (
     SELECT ord, s, e, 1::BIGINT << bits AS size, bits FROM (
       SELECT ord, s, e, (SELECT max(k) FROM range(0, 33) r(k) WHERE s % (1::BIGINT << k) = 0 AND s + (1::BIGINT << k) - 1 <= e) AS bits FROM cut WHERE s <= e)))"""
_REST_SQL = f"""SELECT ord, cidr FROM bt WHERE ord NOT IN (SELECT ord FROM b) UNION ALL SELECT ord, cidr FROM b WHERE NOT EXISTS (SELECT 1 FROM w WHERE b.start <= w.e AND w.start <= b.e)
 UNION ALL SELECT ord, concat({_ip_sql("blk")}, '/', len) FROM cut WHERE blk IS NOT NULL AND ord IN (SELECT b.ord FROM b JOIN w ON b.start <= w.e AND w.start <= b.e)"""


#: Ranges of events: of clicks a blacklist, of purchases a whitelist. Rows are numbered by event, and a range may come more than once.
def _black(spark, d):
    return _event_ranges(spark, d, "click", 12, 21)


def _white(spark, d):
    return _event_ranges(spark, d, "purchase", 18, 15)


def _event_ranges(spark, d, kind, least, n):
    r = req(spark, d).where((F.col("user_agent") == kind) & (F.col("ip") != 0)).withColumn("len", (F.lit(least) + F.col("user_id") % n).cast("int"))
    start = ipcalc.prefix_of(F.col("ip"), F.col("len")) * ipcalc.size_of(F.col("len"))
    return r.select(F.col("event_id").alias("ord"), ipcalc.cidr_text(start, F.col("len")).alias("cidr"))


def _event_ranges_sql(name, kind, least, n):
    size = "(1::BIGINT << (32 - len))"
    return f"""{name} AS (SELECT ord, concat({_ip_sql("start")}, '/', len) AS cidr FROM (SELECT ord, len, ip - ip % {size} AS start FROM (
  SELECT event_id AS ord, CAST({least} + user_id % {n} AS INTEGER) AS len, ip FROM req WHERE user_agent = '{kind}' AND ip <> 0)))"""


_TABLES = f"""WITH RECURSIVE {REQ}, {_event_ranges_sql("bt", "click", 12, 21)}, {_event_ranges_sql("wt", "purchase", 18, 15)}, b AS {_PARSED.format("bt")}, w AS {_PARSED.format("wt")}"""


def _found_ranges(spark, d):
    return clusters.detect(counts(spark, d), [DEEP, STANDARD]).select("start", "len")


def _lines(spark, d, kind="combined"):
    """Log lines of the requests; every eleventh has a malformed status and every thirteenth malformed bytes."""
    r = req(spark, d)
    ip = F.when(F.col("ip") == 0, F.lit("-")).otherwise(ipcalc.long_to_ip(F.col("ip")))
    zone = F.element_at(F.array(F.lit("-0100"), F.lit("+0000"), F.lit("+0100")), (F.col("event_id") % 3 + 1).cast("int"))
    time = F.concat(F.date_format("wall_ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" "), zone)
    status = F.when(F.col("event_id") % 11 == 0, "2XX").otherwise((F.col("event_id") % 400 + 100).cast("string"))
    size = F.when(F.col("event_id") % 13 == 0, "12ab").otherwise((F.col("event_id") * 17).cast("string"))
    agent = F.concat(F.lit('Bot \\"x\\" '), F.col("user_agent"))
    request = F.concat(F.lit("POST "), F.col("uri"), F.lit(" HTTP/1.1"))
    line = {
        "default": F.concat(F.lit("- - - ["), time, F.lit('] "'), request, F.lit('" '), status, F.lit(" "), size, F.lit(' - "'), agent, F.lit('" "'), ip, F.lit('"')),
        "combined": F.concat(ip, F.lit(" - - ["), time, F.lit('] "'), request, F.lit('" '), status, F.lit(" "), size, F.lit(' "ref" "'), agent, F.lit('"')),
        "separate": F.concat(ip, F.lit(" ["), time, F.lit("] "), F.col("uri"), F.lit(" "), status, F.lit(" "), size, F.lit(' "'), agent, F.lit('" DELETE')),
        "forwarded": F.concat(ip, F.lit(", 10.0.0.1 - - ["), time, F.lit('] "'), request, F.lit('" '), status, F.lit(" - "), size),
    }[kind]
    return r.select("event_id", line.alias("value"))


def _with_id(fmt, kind):
    def run(spark, d):
        lines = _lines(spark, d, kind)
        return logformat.parse_lines(lines, fmt).select("*")

    return run


def _parsed_sql(method="POST", agent="concat('Bot \\\\\"x\\\\\" ', user_agent)", size="event_id * 17", bad_bytes="event_id % 13 = 0"):
    return f"""WITH {REQ} SELECT ip, date_trunc('second', wall_ts) AS wall_ts, offset_sec, '{method}' AS method, uri,
 CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 400 + 100 END AS INTEGER) AS status, CAST(CASE WHEN {bad_bytes} THEN 0 ELSE {size} END AS BIGINT) AS bytes,
 {agent} AS user_agent, event_id % 11 = 0 AS bad_status, {bad_bytes} AS bad_bytes FROM req""".replace("\\\\", "\\")


AGENTS = (["view", " Purchase "], ["click", "VIEW", "error"])


def _verdicts(spark, d):
    return filters.with_verdict(req(spark, d), filters.user_agent_list(spark, *AGENTS))


_VERDICT = """v AS (SELECT *, CASE WHEN lower(user_agent) IN ('view', 'purchase') THEN 1 WHEN lower(user_agent) IN ('click', 'error') THEN -1 END AS verdict FROM req)"""
START, END = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)


def _bounds(spark, d, start, end):
    keep = filters.request_filter(start=start, end=end)
    return req(spark, d).where(keep).select("event_id")


def _middle(spark, d, aware):
    lo, hi = _span(spark, d)
    zone = timezone.utc if aware else None
    return _bounds(spark, d, ((lo + (hi - lo) / 4).replace(tzinfo=zone, microsecond=0), aware), ((lo + (hi - lo) / 2).replace(tzinfo=zone, microsecond=0), aware))


def _span(spark, d):
    return tuple(spark.read.parquet(f"{d}/events.parquet").agg(F.min("ts"), F.max("ts")).first())


def _end_only(spark, d):
    lo, hi = _span(spark, d)
    r = req(spark, d).withColumn("wall_ts", F.when(F.col("event_id") % 10 != 0, F.col("wall_ts")))
    return r.where(filters.request_filter(end=((lo + (hi - lo) / 2).replace(microsecond=0), False))).select("event_id")


_MIDDLE = """span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), b AS (SELECT date_trunc('second', lo + (hi - lo) / 4) AS s, date_trunc('second', lo + (hi - lo) / 2) AS e FROM span)"""


_WINDOW_SETS = [ClusterSet(20, 16, 28, 0.5), ClusterSet(10, 20, 32, 0.9), ClusterSet(5, 16, 26, 1.0)]


def _window_rows(spark, d):
    return req(spark, d).where("ip <> 0").select(F.col("wall_ts").alias("ts"), F.col("event_id").alias("arrival"), "ip")


def _window(spark, d, size):
    _, hi = _span(spark, d)
    return windows.survivors(_window_rows(spark, d), F.lit(hi - timedelta(hours=240)).cast("timestamp_ntz"), size)


def _window_ctes(size):
    return f"""{REQ}, q AS (SELECT wall_ts AS ts, event_id AS arrival, ip FROM req WHERE ip <> 0), o AS (SELECT *, max(CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOUR THEN 1 ELSE 0 END) OVER (ORDER BY arrival) AS open FROM q),
 win AS (SELECT ts, arrival, ip FROM (SELECT *, row_number() OVER (ORDER BY arrival DESC) AS back FROM o WHERE open = 1) WHERE back <= {size})"""


NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def _jail(steps) -> jail.Jail:
    j = jail.Jail()
    for minutes, cidrs in steps:
        j.update(cidrs, NOW + timedelta(minutes=minutes))
    return j


def _jailed(steps, at=0):
    def run(spark, d):
        j = _jail(steps)
        j.expire(NOW + timedelta(minutes=at))
        return j.to_frame(spark).select("stage", "cidr", ((F.unix_timestamp("ban_start") - int(NOW.timestamp())) / 60).cast("long").alias("minute"), "active")

    return run


_CLIMB = [(0, ["10.0.0.0/24"]), (11, ["10.0.0.0/24"]), (20, ["10.0.0.0/24"]), (300, ["10.0.0.0/24"])]
_ABSORB = [(0, ["10.0.0.0/25", "10.0.1.0/25"]), (5, ["10.0.0.128/25"]), (6, ["10.0.0.0/24"]), (20, ["10.0.1.0/24"]), (21, ["10.0.1.64/26"])]


def _live_messages(spark, d):
    lines = _lines(spark, d, "combined").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("010.1.1.1 "), F.col("value"))).otherwise(F.col("value")).alias("message"))
    return readers.parse_messages(lines)


def _prune(spark, d):
    j = _jail([(0, ["10.0.0.0/24"]), (400 * 24 * 60, ["10.9.0.0/24"])])
    j.expire(NOW + timedelta(days=400))
    j.prune(NOW + timedelta(days=400))
    return j.to_frame(spark).select("stage", "cidr", "active")


def _stages(spark, d):
    j = _jail(_ABSORB)
    return j.to_frame(spark).groupBy("stage").agg(F.count_if("active").alias("active"), F.count("*").alias("prisoners"))


EDGES = ["10.0.0.1", "010.001.0.1", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "0.0.0.0", "255.255.255.255", "::1", "1..2.30", "1.2.3.4 ", ""]
CIDRS = ["10.1.2.3/8", "0.0.0.0/0", "192.168.1.1/32", "1.2.3.4/33", "10.0.0.0", "::1/128", "01.2.3.4/8", "172.16.5.9/12"]


def _edges(spark, d):
    df = spark.createDataFrame([(x,) for x in EDGES], "address string")
    return df.select("address", ipcalc.ip_to_long(F.col("address")).alias("ip"), ipcalc.is_cidr_or_ip(F.col("address")).alias("valid"), ipcalc.subnet24(F.col("address")).alias("label"))


def _cidr_edges(spark, d):
    df = spark.createDataFrame([(x,) for x in CIDRS], "cidr string")
    s, e, n = ipcalc.cidr_bounds(F.col("cidr"))
    h, _, _ = ipcalc.cidr_bounds(F.col("cidr"), host=True)
    return df.select("cidr", *[F.coalesce(c, F.lit(-1)).alias(k) for c, k in ((s, "start"), (e, "last"), (n, "len"), (h, "host_start"))])


def _list(spark, texts):
    return ranges.parsed(_texts(spark, texts)).where("start IS NOT NULL")


def _list_of(df):
    return ranges.parsed(df).where("start IS NOT NULL").select("start", "len")


def _ban_rows(spark, d):
    return clusters.detect(counts(spark, d), [ClusterSet(1, 24, 32, 0.0)])


def queries() -> dict:
    q = {
        "prefix_counts_d8_24": lambda s, d: prefixes.prefix_counts(counts(s, d), 8, 24).select("depth", "prefix", "cnt"),
        "prefix_counts_children": lambda s, d: prefixes.prefix_counts(counts(s, d), 0, 16),
        "unique_ips": lambda s, d: counts(s, d).agg(F.countDistinct("ip").alias("unique_ips")),
        "total_requests": lambda s, d: counts(s, d).agg(F.sum("cnt").alias("total_requests")),
        "point_count": lambda s, d: counts(s, d).where("ip = 3405803777").agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("n")),
        "trie_stats_unfiltered": lambda s, d: prefixes.stats(req(s, d)),
        "trie_stats_filtered": lambda s, d: filters.counted(_verdicts(s, d).where(filters.request_filter(endpoint_regex="^/(view|click|purchase)/[0-4]"))),
        "trie_stats_by_agent": lambda s, d: filters.counted(_verdicts(s, d), "user_agent"),
        "cidr_range_counts": lambda s, d: prefixes.range_counts(counts(s, d), _list(s, RANGES)).select("start", "len", "n"),
        "cidr_range_slash0": lambda s, d: prefixes.range_counts(counts(s, d), _list(s, ["0.0.0.0/0"])).select("start", "len", "n"),
        "cidr_percent": lambda s, d: prefixes.range_counts(counts(s, d), _list(s, RANGES)).select("start", "len", F.round(prefixes.percent(F.col("n"), F.lit(counts(s, d).agg(F.sum("cnt")).first()[0])), 6).alias("percent")),
        "cluster_coarse": _detect([COARSE]),
        "cluster_standard": _detect([STANDARD]),
        "cluster_deep": _detect([DEEP]),
        "cluster_multi_set": _detect([COARSE, STANDARD, DEEP, ClusterSet(50, 30, 32, 0.2)]),
        "cluster_threshold0": _detect([ClusterSet(2, 24, 32, 0.0)]),
        "cluster_negative_threshold": _detect([ClusterSet(5, 16, 30, -1.0)]),
        "cluster_root_trap": _detect([ClusterSet(0, 0, 4, 1000000.0)]),
        "cluster_lineitem": lambda s, d: clusters.detect(s.read.parquet(f"{d}/lineitem.parquet").selectExpr("(l_orderkey * 2654435761L) % 4294967296L AS ip").where("ip <> 0").groupBy("ip").agg(F.count("*").alias("cnt")), [ClusterSet(200, 8, 24, 0.2)]),
        "cluster_percentages": lambda s, d: clusters.cluster_report(counts(s, d), clusters.detect(counts(s, d), [STANDARD, COARSE])).withColumn("percent", F.round("percent", 6)),
        "cluster_set_totals": lambda s, d: clusters.cluster_report(counts(s, d), clusters.detect(counts(s, d), [STANDARD, COARSE])).groupBy("set_id").agg(F.sum("requests").alias("requests")),
        "remove_contained": lambda s, d: ranges.remove_contained(_found_ranges(s, d)),
        "merge_ranges": lambda s, d: ranges.merge_ranges(_ban_rows(s, d).select("start", "len")),
        "interval_union": lambda s, d: ranges.interval_union(_found_ranges(s, d)),
        "interval_cover": lambda s, d: ranges.cover(counts(s, d).select("ip", F.col("ip").alias("start"), (F.col("ip") + F.col("ip") % 1000).alias("end")).where("end < 4294967296")),
        "interval_subtract": lambda s, d: ranges.remove_whitelisted(_texts(s, BLACK[:2]), _texts(s, WHITE)),
        "remove_whitelisted": lambda s, d: ranges.remove_whitelisted(_black(s, d), _white(s, d)),
        "remove_whitelisted_odd": lambda s, d: ranges.remove_whitelisted(_texts(s, BLACK), _texts(s, WHITE)),
        "whitelist_drop_full": lambda s, d: ranges.drop_fully_whitelisted(_black(s, d), _white(s, d)),
        "whitelist_covered_union": lambda s, d: ranges.covered_by_union(_black(s, d), _white(s, d)),
        "whitelist_overlap": lambda s, d: ranges.overlapping(_black(s, d), _white(s, d)),
        "publish_bans": lambda s, d: ranges.compose_ban_lists(_black(s, d), _white(s, d), _texts(s, WHITE)),
        "ranges_outermost": lambda s, d: ranges.remove_contained(_list_of(_black(s, d))),
        "ranges_union": lambda s, d: ranges.interval_union(_list_of(_black(s, d).union(_white(s, d)))),
        "filter_time_wall": lambda s, d: _middle(s, d, False),
        "filter_time_instant": lambda s, d: _middle(s, d, True),
        "filter_time_end_only_missing_ts": _end_only,
        "filter_ua_regex": lambda s, d: req(s, d).where(filters.request_filter(user_agent_regex="^(click|err.*)$")).select("event_id"),
        "filter_endpoint_regex": lambda s, d: req(s, d).where(filters.request_filter(endpoint_regex="/view/[[:digit:]]$")).select("event_id"),
        "filter_pages_url_regex": lambda s, d: s.read.parquet(f"{d}/pages.parquet").where(matches(F.col("url"), r"/(en|fr)/\d+")).select("page_id"),
        "filter_literal_alternatives": lambda s, d: req(s, d).where(filters.request_filter(user_agent_regex="iew|lick")).select("event_id"),
        "filter_combined": lambda s, d: req(s, d).where(filters.request_filter(user_agent_regex="view|click", endpoint_regex=".*[1-5]$", start=(START, False))).select("event_id"),
        "filter_empty_never_matches": lambda s, d: req(s, d).withColumn("user_agent", F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("user_agent"))).where(filters.request_filter(user_agent_regex=".*")).select("event_id"),
        "ua_verdict": lambda s, d: _verdicts(s, d).select("event_id", F.coalesce("verdict", F.lit(0)).alias("verdict")),
        "ua_whitelist_ips": lambda s, d: filters.listed_ranges(_verdicts(s, d), 1),
        "ua_blacklist_cidrs": lambda s, d: filters.listed_ranges(_verdicts(s, d), -1),
        "ua_precedence": lambda s, d: filters.user_agent_list(s, *AGENTS),
        "parse_default": _with_id(logformat.DEFAULT_FORMAT, "default"),
        "parse_combined": _with_id('%h %^ %^ [%t] "%r" %s %b "%^" "%u"', "combined"),
        "parse_separate_fields": _with_id('%h [%t] %U %s %b "%u" %m', "separate"),
        "parse_forwarded_for": _with_id('%h, %^ %^ %^ [%t] "%r" %s %^ %b', "forwarded"),
        "parse_escaped_quotes": lambda s, d: logformat.parse_lines(_lines(s, d, "default")).groupBy("user_agent").agg(F.count("*").alias("n")),
        "parse_malformed_counts": lambda s, d: logformat.parse_lines(_lines(s, d, "default")).agg(F.count_if("bad_status").alias("bad_status"), F.count_if("bad_bytes").alias("bad_bytes"), F.count_if(F.col("ip") == 0).alias("invalid_ips")),
        "parse_ip_only": lambda s, d: logformat.parse_ips(_lines(s, d, "default")).groupBy("ip").agg(F.count("*").alias("n")),
        "parse_live_message": lambda s, d: _live_messages(s, d).select("event_id", "parse_error", "ip", "wall_ts", "offset_sec", "method", "uri", "status", "bytes", "user_agent"),
        "ip_format": lambda s, d: counts(s, d).select("ip", ipcalc.long_to_ip(F.col("ip")).alias("address"), ipcalc.octet(F.col("ip"), 1).alias("o1"), ipcalc.octet(F.col("ip"), 3).alias("o3")),
        "ip_parse_edges": _edges,
        "cidr_bounds": _cidr_edges,
        "subnet24_label": lambda s, d: counts(s, d).groupBy(ipcalc.subnet24(ipcalc.long_to_ip(F.col("ip"))).alias("subnet")).agg(F.sum("cnt").alias("n")),
        "heatmap16": lambda s, d: grids.grid(counts(s, d)),
        "grid_blocks8": lambda s, d: grids.blocks(grids.grid(counts(s, d))),
        "grid_intensity": lambda s, d: grids.intensity(grids.blocks(grids.grid(counts(s, d))), "sqrt").select("b1", "b2", F.round("intensity", 6).alias("intensity")),
        "grid_clustered": lambda s, d: grids.clustered_grid(counts(s, d), clusters.detect(counts(s, d), [STANDARD])),
        "grid_capture": lambda s, d: grids.capture(grids.grid(counts(s, d)), grids.clustered_grid(counts(s, d), clusters.detect(counts(s, d), [STANDARD]))).select("o1", "o2", "n", "c", "bucket"),
        "top_talkers": lambda s, d: prefixes.top_talkers(counts(s, d), 20),
        "top_talkers_ties": lambda s, d: prefixes.top_talkers(counts(s, d).withColumn("cnt", F.lit(4).cast("long")), 7),
        "top_talkers_none": lambda s, d: prefixes.top_talkers(counts(s, d), 0),
        "active_bans_capped": _live_bans,
        "window_survivors_time": lambda s, d: _window(s, d, 1 << 40),
        "window_survivors_size": lambda s, d: _window(s, d, 200),
        "window_ip_stats": lambda s, d: windows.address_stats(_window(s, d, 400)),
        "window_cluster": lambda s, d: clusters.detect(_window(s, d, 300).groupBy("ip").agg(F.count("*").alias("cnt")), _WINDOW_SETS),
        "request_rates": lambda s, d: windows.rates(req(s, d).where("ip <> 0"), ipcalc.subnet24(ipcalc.long_to_ip(F.col("ip"))), "subnet"),
        "request_rates_by_agent": lambda s, d: windows.rates(req(s, d), F.col("user_agent"), "user_agent", 3600),
        "jail_first_offense": _jailed([(0, ["10.0.0.0/24", "203.0.113.0/26"])]),
        "jail_escalate": _jailed(_CLIMB, 301),
        "jail_absorb": _jailed(_ABSORB, 22),
        "jail_prune": _prune,
        "jail_stage_counts": _stages,
        "jail_active_meta": lambda s, d: _jail(_ABSORB).to_frame(s).where("active").select("cidr", "stage", ((F.unix_timestamp("expires") - int(NOW.timestamp())) / 60).cast("long").alias("expires_minute")),
        "synth_log_shape": lambda s, d: logformat.parse_lines(synth.synthetic_log(s, 20000, 7), synth.FORMAT).groupBy("method").agg(F.count("*").alias("n"), F.countDistinct("user_agent").alias("agents")),
        "static_report": lambda s, d: _static_report(s, d),
        "static_stats": lambda s, d: _static_stats(s, d),
        "static_jail": lambda s, d: _static_jail(s, d),
        "stream_window_cluster": lambda s, d: _stream(s, d),
        "stream_ua_ttl": lambda s, d: _stream_listed(s, d),
    }
    return q


_VIEWS = ClusterSet(50, 16, 28, 0.5)


def _report(spark, d):
    from rangewarden.plans.config import Trie
    from rangewarden.plans.static import analyse

    tries = [Trie("all", sets=(STANDARD, DEEP)), Trie("views", user_agent_regex="view", sets=(_VIEWS,), ranges=tuple(RANGES[:2]))]
    return analyse(spark, req(spark, d), tries, filters.user_agent_list(spark, ["purchase"], ["error"]))


def _static_report(spark, d):
    """Ranges that the tries' cluster sets find, and those that were asked for (set -1)."""
    rows = [(t["name"], i, r["cidr"], r["requests"], round(r["percentage"], 6)) for t in _report(spark, d)["tries"] for i, found in [*enumerate(s["detected_ranges"] for s in t["clusters"]), (-1, t["cidr_ranges"])] for r in found]
    return spark.createDataFrame(rows, "trie string, set_id int, cidr string, requests long, percentage double")


def _static_stats(spark, d):
    rows = [(t["name"], *(t["stats"][k] for k in ("total_requests_after_filtering", "unique_ips", "skipped_invalid_ips", "ua_whitelisted", "ua_blacklisted"))) for t in _report(spark, d)["tries"]]
    return spark.createDataFrame(rows, "trie string, total long, unique_ips long, invalid long, white long, black long")


def _static_jail(spark, d):
    """Bans of a fresh jail that took the ranges of one trie and the addresses of blacklisted agents, and the sections of the ban file."""
    import tempfile

    from rangewarden.plans.config import Config, Trie
    from rangewarden.plans.static import analyse, publish
    from rangewarden.shipping import scratch

    folder = tempfile.mkdtemp(prefix="rangewarden-")  # jail and ban file are files of the driver
    config = Config(jail_file=f"{folder}/jail.json", ban_file=f"{folder}/ban.txt")
    jailing = Trie("views", sets=(ClusterSet(20, 16, 24, 0.5, True),))
    with scratch(spark) as shared:
        report = analyse(spark, req(spark, d), [jailing], filters.user_agent_list(spark, ["purchase"], ["error"]), listed_to=f"{shared}/listed")
        publish(spark, config, report | {"warnings": [], "errors": []}, {"whitelist": WHITE, "blacklist": BLACK[:2]}, NOW, spark.read.parquet(f"{shared}/listed"))
    return _ban_sections(spark, config.ban_file)


def _ban_sections(spark, path):
    """The lines of a ban file with their section. Files of the shared folder hold them until the rows are read: there may be more than the driver can hold."""
    import uuid

    from rangewarden.shipping import share, shared_dir

    heads = {"# Active jail bans:": "bans", "# Manual blacklist entries:": "blacklist"}
    to = f"{shared_dir(spark)}/bans-{uuid.uuid4().hex}"
    out = {section: open(f"{path}.{section}", "w", encoding="utf-8") for section in heads.values()}
    with open(path, encoding="utf-8") as f:
        section = None
        for line in map(str.rstrip, f):
            if line.startswith("#"):
                section = heads.get(line, section)
            else:
                out[section].write(f"{line}\n")
    parts = []
    for section, f in out.items():
        f.close()
        parts.append(spark.read.text(share(spark, f.name, f"{to}/{section}.txt")).select(F.lit(section).alias("section"), F.col("value").alias("cidr")))
    return parts[0].union(parts[1])


def _live(spark, windows, clock, **lists):
    import tempfile
    import uuid

    from rangewarden.plans.config import Config
    from rangewarden.shipping import shared_dir
    from rangewarden.streaming.live import LiveEngine

    folder = tempfile.mkdtemp(prefix="rangewarden-")  # jail, ban file and lists are files of the driver
    paths = {}
    for name, entries in lists.items():
        paths[name] = f"{folder}/{name}"
        with open(paths[name], "w", encoding="utf-8") as f:
            f.writelines(f"{x}\n" for x in entries)
    config = Config(jail_file=f"{folder}/jail.json", ban_file=f"{folder}/ban.txt", port="5044", windows=windows, **paths)
    return LiveEngine(spark, config, f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", clock)


def _messages(spark, d, lo, hi):
    """Live messages of the events from one id up to another, in their order."""
    lines = _lines(spark, d, "combined").where(F.col("event_id").between(lo, hi))
    return lines.orderBy("event_id").select(F.col("value").alias("message"))


def _batches(spark, d, n):
    least, most = spark.read.parquet(f"{d}/events.parquet").agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [least + (most - least + 1) * i // n for i in range(n + 1)]
    return [_messages(spark, d, a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _window_of(name, max_age, max_size, *sets):
    from rangewarden.plans.config import Trie

    return Trie(name, sets=sets, max_age=max_age, max_size=max_size)


def _stream(spark, d):
    """The ranges in a window of 5,000 requests after the live engine has taken all events in three batches."""
    sets = (ClusterSet(50, 16, 28, 0.5),)
    engine = _live(spark, [_window_of("all", timedelta(days=100_000), 5000, *sets)], lambda: NOW)
    for i, batch in enumerate(_batches(spark, d, 3)):
        engine.process(batch, i)
    return clusters.detect(prefixes.address_counts(engine.window_rows("all")), list(sets))


def _stream_listed(spark, d):
    """Addresses of listed agents that the live engine still knows an hour after the last of two batches, which came an hour after the first."""
    hours = [0]
    engine = _live(spark, [_window_of("short", timedelta(minutes=90), 1000, ClusterSet(10**9, 32, 32, 0.0))], lambda: NOW + timedelta(hours=hours[0]), ua_whitelist=["Bot \\\"x\\\" view"], ua_blacklist=["Bot \\\"x\\\" click"])
    for i, batch in enumerate(_batches(spark, d, 2)):
        hours[0] = i
        engine.process(batch, i)
    hours[0] = 2
    return engine.listed_addresses(1).select("ip", F.lit(1).alias("verdict")).union(engine.listed_addresses(-1).select("ip", F.lit(-1)))


def _live_bans(spark, d):
    """What a snapshot lists of the bans after one batch of all events: the first 500 in order of their addresses."""
    engine = _live(spark, [_window_of("all", timedelta(days=100_000), 1 << 40, ClusterSet(2, 20, 32, 0.0, True))], lambda: NOW)
    engine.process(_batches(spark, d, 1)[0], 0)
    bans = engine.snapshot["jail"]["bans"]
    return spark.createDataFrame([(b["cidr"],) for b in bans], "cidr string")


def oracle_sql() -> dict[str, str]:
    w = f"WITH {REQ}"
    wt = f"WITH {T}"
    wv = f"WITH {REQ}, {_VERDICT}"
    counted = """CAST(sum(CASE WHEN ip = 0 THEN 1 ELSE 0 END) AS BIGINT) AS skipped_invalid_ips, CAST(sum(CASE WHEN ip <> 0 AND verdict = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ua_whitelisted,
 CAST(sum(CASE WHEN ip <> 0 AND verdict = -1 THEN 1 ELSE 0 END) AS BIGINT) AS ua_blacklisted, CAST(sum(CASE WHEN ip <> 0 AND (verdict IS NULL OR verdict <> 1) THEN 1 ELSE 0 END) AS BIGINT) AS total_after_filter,
 count(DISTINCT CASE WHEN ip <> 0 AND (verdict IS NULL OR verdict <> 1) THEN ip END) AS unique_ips"""
    rng = f"WITH {T}, rt(ord, cidr) AS (VALUES {_values(RANGES)}), rg AS {_PARSED.format('rt')}, rc AS (SELECT start, len, (SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) FROM t WHERE ip BETWEEN rg.start AND rg.e) AS n FROM rg)"
    report = f"""WITH {T}, {_cluster_ctes([STANDARD, COARSE])}, rep AS (SELECT set_id, concat({_ip_sql("start")}, '/', len) AS cidr, (SELECT CAST(sum(cnt) AS BIGINT) FROM t WHERE ip >= start AND ip < start + (1::BIGINT << (32 - len))) AS requests FROM found)"""
    bans = f"WITH {T}, {_cluster_ctes([ClusterSet(1, 24, 32, 0.0)])}"
    both = f"WITH {T}, {_cluster_ctes([DEEP, STANDARD])}, fr AS (SELECT DISTINCT start, len, start + (1::BIGINT << (32 - len)) - 1 AS e FROM found)"
    std = f"WITH {T}, {_cluster_ctes([STANDARD])}, g AS (SELECT CAST(ip >> 24 AS INTEGER) AS o1, CAST((ip >> 16) & 255 AS INTEGER) AS o2, CAST(sum(cnt) AS BIGINT) AS n FROM t GROUP BY ALL), cg AS (SELECT CAST(ip >> 24 AS INTEGER) AS o1, CAST((ip >> 16) & 255 AS INTEGER) AS o2, CAST(sum(cnt) AS BIGINT) AS n FROM t WHERE EXISTS (SELECT 1 FROM found WHERE ip >= start AND ip < start + (1::BIGINT << (32 - len))) GROUP BY ALL)"
    grid = f"WITH {T}, g AS (SELECT CAST(ip >> 24 AS INTEGER) AS o1, CAST((ip >> 16) & 255 AS INTEGER) AS o2, CAST(sum(cnt) AS BIGINT) AS n FROM t GROUP BY ALL)"
    step = lambda name, base: f"""{name} AS (SELECT i, start AS cs, len AS cl, NULL::BIGINT AS es, NULL::INTEGER AS el FROM {base} WHERE i = 1
 UNION ALL SELECT i, CASE WHEN m THEN cs ELSE start END, CASE WHEN m THEN cl - 1 ELSE len END, CASE WHEN m THEN NULL ELSE cs END, CASE WHEN m THEN NULL ELSE cl END
 FROM (SELECT b.i, b.start, b.len, p.cs, p.cl, b.len = p.cl AND p.cs + (1::BIGINT << (32 - b.len)) = b.start AND p.cs % (1::BIGINT << (33 - b.len)) = 0 AS m FROM {name} p JOIN {base} b ON b.i = p.i + 1)),
 {name}_out AS (SELECT row_number() OVER (ORDER BY start, len) AS i, start, len FROM (SELECT es AS start, el AS len FROM {name} WHERE es IS NOT NULL UNION ALL SELECT cs, cl FROM {name} WHERE i = (SELECT max(i) FROM {name})))"""  # noqa: E731
    merged = f"""{bans.replace("WITH", "WITH RECURSIVE", 1)}, base AS (SELECT row_number() OVER (ORDER BY start, len) AS i, start, len FROM found), {step("p1", "base")}, {step("p2", "p1_out")} SELECT start, len FROM p2_out"""
    live_base = f"WITH RECURSIVE {T}, {_cluster_ctes([ClusterSet(2, 20, 32, 0.0)])}"
    live_merged = f"""{live_base}, base AS (SELECT row_number() OVER (ORDER BY start, len) AS i, start, len FROM found), {step("p1", "base")}, {step("p2", "p1_out")}"""
    kept = f"{REQ}, v AS (SELECT *, CASE user_agent WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS verdict FROM req), t AS (SELECT ip, count(*) AS cnt FROM v WHERE ip <> 0 AND verdict IS DISTINCT FROM 1"
    trie = lambda name, where, sets: f"""SELECT '{name}' AS trie, set_id, concat({_ip_sql("start")}, '/', len) AS cidr, cnt AS requests, round(cnt / total * 100, 6) AS percentage FROM (
 WITH {kept}{where} GROUP BY ip), {_cluster_ctes(sets)} SELECT *, (SELECT sum(cnt) FROM t) AS total FROM found)"""  # noqa: E731
    asked = f"""SELECT 'views' AS trie, -1 AS set_id, cidr, n AS requests, round(n / total * 100, 6) AS percentage FROM (WITH {kept} AND user_agent LIKE '%view%' GROUP BY ip), rt(ord, cidr) AS (VALUES {_values(RANGES[:2])}), rg AS {_PARSED.format("rt")}
 SELECT cidr, (SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) FROM t WHERE ip BETWEEN rg.start AND rg.e) AS n, (SELECT sum(cnt) FROM t) AS total FROM rg)"""
    static = f"{trie('all', '', [STANDARD, DEEP])} UNION ALL {trie('views', " AND user_agent LIKE '%view%'", [_VIEWS])} UNION ALL {asked}"
    static_stats = f"""WITH {REQ}, x AS (SELECT 'all' AS trie, * FROM req UNION ALL SELECT 'views', * FROM req WHERE user_agent LIKE '%view%')
 SELECT trie, count(*) FILTER (ip <> 0 AND user_agent <> 'purchase') AS total, count(DISTINCT ip) FILTER (ip <> 0 AND user_agent <> 'purchase') AS unique_ips, count(*) FILTER (ip = 0) AS invalid,
 count(*) FILTER (ip <> 0 AND user_agent = 'purchase') AS white, count(*) FILTER (ip <> 0 AND user_agent = 'error') AS black FROM x GROUP BY trie"""
    jailing = f"WITH RECURSIVE {kept} GROUP BY ip), {_cluster_ctes([ClusterSet(20, 16, 24, 0.5)])}, base AS (SELECT row_number() OVER (ORDER BY start, len) AS i, start, len FROM found), {step('p1', 'base')}, {step('p2', 'p1_out')}"
    static_jail = f"""{jailing}, wt AS (SELECT * FROM (VALUES {_values(WHITE)}) x(ord, cidr) UNION ALL SELECT 1000 + row_number() OVER (), concat({_ip_sql('ip')}, '/32') FROM (SELECT DISTINCT ip FROM v WHERE verdict = 1 AND ip <> 0)), w AS {_PARSED.format('wt')},
 jailed AS (SELECT start, start + (1::BIGINT << (32 - len)) - 1 AS e, len FROM p2_out p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.start <= p.start AND w.e >= p.start + (1::BIGINT << (32 - p.len)) - 1)),
 every AS (SELECT start, len FROM jailed UNION ALL SELECT ip, 32 FROM (SELECT DISTINCT ip FROM v WHERE verdict = -1 AND ip <> 0) q WHERE NOT EXISTS (SELECT 1 FROM jailed j WHERE q.ip BETWEEN j.start AND j.e)),
 bt AS (SELECT row_number() OVER (ORDER BY start, len) AS ord, concat({_ip_sql('start')}, '/', len) AS cidr FROM every UNION ALL SELECT -1 - ord, cidr FROM (VALUES {_values(BLACK[:2])}) y(ord, cidr)), b AS {_PARSED.format('bt')}
 {_CUT_SQL} SELECT CASE WHEN ord < 0 THEN 'blacklist' ELSE 'bans' END AS section, cidr FROM ({_REST_SQL})"""
    parsed_agent = "concat('Bot \\\"x\\\" ', user_agent)".replace('\\"', '\\"')
    return {
        "prefix_counts_d8_24": f"{wt} SELECT CAST(d AS INTEGER) AS depth, ip >> (32 - d) AS prefix, CAST(sum(cnt) AS BIGINT) AS cnt FROM t, range(8, 25) g(d) GROUP BY d, ip >> (32 - d)",
        "prefix_counts_children": f"""{wt} SELECT CAST(d AS INTEGER) AS depth, ip >> (32 - d) AS prefix, CAST(sum(CASE WHEN d = 0 THEN 0 ELSE cnt END) AS BIGINT) AS cnt,
 CAST(sum(CASE WHEN d < 16 AND (ip >> (31 - d)) & 1 = 0 THEN cnt ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN d < 16 AND (ip >> (31 - d)) & 1 = 1 THEN cnt ELSE 0 END) AS BIGINT) AS r FROM t, range(0, 17) g(d) GROUP BY d, ip >> (32 - d)""",
        "unique_ips": f"{w} SELECT count(DISTINCT ip) AS unique_ips FROM req WHERE ip <> 0",
        "total_requests": f"{w} SELECT count(*) AS total_requests FROM req WHERE ip <> 0",
        "point_count": f"{w} SELECT count(*) AS n FROM req WHERE ip = 3405803777",
        "trie_stats_unfiltered": f"{w} SELECT CAST(sum((ip = 0)::INT) AS BIGINT) AS skipped_invalid_ips, CAST(sum((ip <> 0)::INT) AS BIGINT) AS total_requests, count(DISTINCT nullif(ip, 0)) AS unique_ips FROM req",
        "trie_stats_filtered": f"{wv} SELECT {counted} FROM v WHERE uri <> '' AND regexp_matches(uri, '^/(view|click|purchase)/[0-4]')",
        "trie_stats_by_agent": f"{wv} SELECT user_agent, {counted} FROM v GROUP BY user_agent",
        "cidr_range_counts": f"{rng} SELECT * FROM rc",
        "cidr_range_slash0": f"{wt} SELECT 0::BIGINT AS start, 0::INTEGER AS len, CAST(sum(cnt) AS BIGINT) AS n FROM t",
        "cidr_percent": f"{rng} SELECT start, len, round(n / (SELECT sum(cnt) FROM t) * 100, 6) AS percent FROM rc",
        "cluster_coarse": _detect_sql([COARSE]),
        "cluster_standard": _detect_sql([STANDARD]),
        "cluster_deep": _detect_sql([DEEP]),
        "cluster_multi_set": _detect_sql([COARSE, STANDARD, DEEP, ClusterSet(50, 30, 32, 0.2)]),
        "cluster_threshold0": _detect_sql([ClusterSet(2, 24, 32, 0.0)]),
        "cluster_negative_threshold": _detect_sql([ClusterSet(5, 16, 30, -1.0)]),
        "cluster_root_trap": _detect_sql([ClusterSet(0, 0, 4, 1000000.0)]),
        "cluster_lineitem": _detect_sql([ClusterSet(200, 8, 24, 0.2)], "t AS (SELECT (l_orderkey * 2654435761) % 4294967296 AS ip, count(*) AS cnt FROM lineitem WHERE (l_orderkey * 2654435761) % 4294967296 <> 0 GROUP BY 1)"),
        "cluster_percentages": f"{report} SELECT set_id, cidr, requests, round(requests / (SELECT sum(cnt) FROM t) * 100, 6) AS percent FROM rep",
        "cluster_set_totals": f"{report} SELECT set_id, CAST(sum(requests) AS BIGINT) AS requests FROM rep GROUP BY set_id",
        "remove_contained": f"{both} SELECT start, len FROM fr WHERE NOT EXISTS (SELECT 1 FROM fr o WHERE o.start <= fr.start AND o.e >= fr.e AND o.len < fr.len)",
        "merge_ranges": merged,
        "interval_union": f"""{both}, o AS (SELECT start, e, max(e) OVER (ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fr), i AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m + 1 THEN 1 ELSE 0 END) OVER (ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT min(start) AS start, max(e) AS "end" FROM i GROUP BY k""",
        "interval_cover": f"""WITH {T}, a AS (SELECT ip, ip + ip % 1000 AS e, unnest(generate_series(ip, ip + ip % 1000)) AS x FROM t WHERE ip + ip % 1000 < 4294967296),
 k AS (SELECT ip, x, max(k) AS k FROM a, range(0, 11) g(k) WHERE x - x % (1::BIGINT << k) >= ip AND x - x % (1::BIGINT << k) + (1::BIGINT << k) - 1 <= e GROUP BY ip, x)
 SELECT DISTINCT ip, x - x % (1::BIGINT << k) AS start, CAST(32 - k AS INTEGER) AS len FROM k""",
        "interval_subtract": f"{_lists_sql()}{_CUT_SQL} SELECT ord::BIGINT AS ord, cidr FROM ({_REST_SQL}) WHERE ord < 2",
        "remove_whitelisted": f"{_TABLES}{_CUT_SQL} SELECT ord, cidr FROM ({_REST_SQL})",
        "remove_whitelisted_odd": f"{_lists_sql()}{_CUT_SQL} SELECT ord::BIGINT AS ord, cidr FROM ({_REST_SQL})",
        "whitelist_drop_full": f"{_TABLES} SELECT ord, cidr FROM bt WHERE ord NOT IN (SELECT b.ord FROM b JOIN w ON b.start >= w.start AND b.e <= w.e)",
        "whitelist_covered_union": f"{_TABLES}{_CUT_SQL} SELECT ord, cidr FROM b WHERE ord NOT IN (SELECT ord FROM ({_REST_SQL}))",
        "whitelist_overlap": f"{_TABLES} SELECT DISTINCT b.ord, b.cidr FROM b JOIN w ON b.start <= w.e AND w.start <= b.e",
        "publish_bans": f"""WITH RECURSIVE {REQ}, {_event_ranges_sql("bb", "click", 12, 21)}, {_event_ranges_sql("ww", "purchase", 18, 15)}, bt AS (SELECT ord, cidr FROM bb UNION ALL SELECT -ord - 1, cidr FROM ww), wt(ord, cidr) AS (VALUES {_values(WHITE)}), b AS {_PARSED.format("bt")}, w AS {_PARSED.format("wt")}
 {_CUT_SQL} SELECT CASE WHEN ord < 0 THEN -ord - 1 ELSE ord END AS ord, cidr, CASE WHEN ord < 0 THEN 'blacklist' ELSE 'bans' END AS section FROM ({_REST_SQL})""",
        "ranges_outermost": f"{_TABLES}, d AS (SELECT DISTINCT start, e, len FROM b) SELECT start, len FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.start <= d.start AND o.e >= d.e AND o.len < d.len)",
        "ranges_union": f"""{_TABLES}, d AS (SELECT start, e FROM b UNION SELECT start, e FROM w), o AS (SELECT start, e, max(e) OVER (ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM d), i AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m + 1 THEN 1 ELSE 0 END) OVER (ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT min(start) AS start, max(e) AS "end" FROM i GROUP BY k""",
        "filter_time_wall": f"{w}, {_MIDDLE} SELECT event_id FROM req, b WHERE wall_ts BETWEEN s AND e",
        "filter_time_instant": f"{w}, {_MIDDLE} SELECT event_id FROM req, b WHERE wall_ts - to_seconds(offset_sec) BETWEEN s AND e",
        "filter_time_end_only_missing_ts": f"{w}, {_MIDDLE} SELECT event_id FROM req, b WHERE event_id % 10 = 0 OR wall_ts <= e",
        "filter_ua_regex": f"{w} SELECT event_id FROM req WHERE regexp_matches(user_agent, '^(click|err.*)$')",
        "filter_endpoint_regex": f"{w} SELECT event_id FROM req WHERE regexp_matches(uri, '/view/[[:digit:]]$')",
        "filter_pages_url_regex": r"SELECT page_id FROM pages WHERE regexp_matches(url, '/(en|fr)/\d+')",
        "filter_literal_alternatives": f"{w} SELECT event_id FROM req WHERE regexp_matches(user_agent, 'iew|lick')",
        "filter_combined": f"{w} SELECT event_id FROM req WHERE regexp_matches(user_agent, 'view|click') AND regexp_matches(uri, '.*[1-5]$') AND wall_ts >= TIMESTAMP '{START}'",
        "filter_empty_never_matches": f"{w} SELECT event_id FROM req WHERE event_id % 2 <> 0",
        "ua_verdict": f"{wv} SELECT event_id, coalesce(verdict, 0) AS verdict FROM v",
        "ua_whitelist_ips": f"{wv} SELECT DISTINCT concat({_ip_sql('ip')}, '/32') AS cidr FROM v WHERE verdict = 1 AND ip <> 0",
        "ua_blacklist_cidrs": f"{wv} SELECT DISTINCT concat({_ip_sql('ip')}, '/32') AS cidr FROM v WHERE verdict = -1 AND ip <> 0",
        "ua_precedence": "SELECT * FROM (VALUES ('click', -1), ('error', -1), ('purchase', 1), ('view', 1)) x(ua_lc, verdict)",
        "parse_default": _parsed_sql(),
        "parse_combined": _parsed_sql(),
        "parse_separate_fields": _parsed_sql("DELETE"),
        "parse_forwarded_for": _parsed_sql(agent="''"),
        "parse_escaped_quotes": f"{w} SELECT {parsed_agent} AS user_agent, count(*) AS n FROM req GROUP BY 1",
        "parse_malformed_counts": f"{w} SELECT count(*) FILTER (event_id % 11 = 0) AS bad_status, count(*) FILTER (event_id % 13 = 0) AS bad_bytes, count(*) FILTER (ip = 0) AS invalid_ips FROM req",
        "parse_ip_only": f"{w} SELECT ip, count(*) AS n FROM req GROUP BY ip",
        "parse_live_message": f"""{w} SELECT event_id, CASE WHEN event_id % 7 = 0 OR ip = 0 THEN 'bad address' END AS parse_error, CASE WHEN event_id % 7 = 0 THEN 0 ELSE ip END AS ip, date_trunc('second', wall_ts) AS wall_ts, offset_sec, 'POST' AS method, uri,
 CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 400 + 100 END AS INTEGER) AS status, CAST(CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id * 17 END AS BIGINT) AS bytes, {parsed_agent} AS user_agent FROM req""",
        "ip_format": f"{wt} SELECT ip, {_ip_sql('ip')} AS address, CAST(ip >> 24 AS INTEGER) AS o1, CAST((ip >> 8) & 255 AS INTEGER) AS o3 FROM t",
        "ip_parse_edges": """SELECT * FROM (VALUES ('10.0.0.1', 167772161::BIGINT, true, '10.0.0.0/24'), ('010.001.0.1', 167837697, false, '010.001.0.0/24'), ('256.1.1.1', 0, false, '256.1.1.0/24'), ('1.2.3', 0, false, '1.2.3'), ('1.2.3.4.5', 0, false, '1.2.3.4.5'),
 ('a.b.c.d', 0, false, 'a.b.c.d'), ('0.0.0.0', 0, true, '0.0.0.0/24'), ('255.255.255.255', 4294967295, true, '255.255.255.0/24'), ('::1', 0, false, '::1'), ('1..2.30', 16777758, false, '1..2.30'), ('1.2.3.4 ', 0, false, '1.2.3.4 '), ('', 0, false, '')) x(address, ip, valid, label)""",
        "cidr_bounds": """SELECT * FROM (VALUES ('10.1.2.3/8', 167772160::BIGINT, 184549375::BIGINT, 8, 167838211::BIGINT), ('0.0.0.0/0', 0, 4294967295, 0, 0), ('192.168.1.1/32', 3232235777, 3232235777, 32, 3232235777), ('1.2.3.4/33', -1, -1, -1, -1), ('10.0.0.0', -1, -1, -1, -1),
 ('::1/128', -1, -1, -1, -1), ('01.2.3.4/8', -1, -1, -1, -1), ('172.16.5.9/12', 2886729728, 2887778303, 12, 2886731017)) x(cidr, start, last, len, host_start)""",
        "subnet24_label": f"{wt} SELECT concat_ws('.', ip >> 24, (ip >> 16) & 255, (ip >> 8) & 255, '0/24') AS subnet, CAST(sum(cnt) AS BIGINT) AS n FROM t GROUP BY 1",
        "heatmap16": f"{grid} SELECT * FROM g",
        "grid_blocks8": f"{grid} SELECT (o1 // 8)::BIGINT AS b1, (o2 // 8)::BIGINT AS b2, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL",
        "grid_intensity": f"{grid}, k AS (SELECT (o1 // 8)::BIGINT AS b1, (o2 // 8)::BIGINT AS b2, sum(n) AS n FROM g GROUP BY ALL) SELECT b1, b2, round(sqrt(n / max(n) OVER ()), 6) AS intensity FROM k",
        "grid_clustered": f"{std} SELECT * FROM cg",
        "grid_capture": f"{std} SELECT g.o1, g.o2, g.n, coalesce(cg.n, 0) AS c, CASE WHEN coalesce(cg.n, 0) / g.n >= 0.8 THEN 'full' WHEN coalesce(cg.n, 0) / g.n >= 0.2 THEN 'part' WHEN coalesce(cg.n, 0) > 0 THEN 'some' ELSE 'none' END AS bucket FROM g LEFT JOIN cg USING (o1, o2)",
        "top_talkers": f"{wt} SELECT ip, cnt FROM t ORDER BY cnt DESC, ip LIMIT 20",
        "top_talkers_ties": f"{wt} SELECT ip, 4::BIGINT AS cnt FROM t ORDER BY ip LIMIT 7",
        "top_talkers_none": f"{wt} SELECT ip, cnt FROM t LIMIT 0",
        "active_bans_capped": f"{live_merged} SELECT cidr FROM (SELECT concat({_ip_sql('start')}, '/', len) AS cidr, start, len FROM p2_out) ORDER BY start, len LIMIT 500",
        "static_report": static,
        "static_stats": static_stats,
        "static_jail": static_jail,
        "stream_window_cluster": f"WITH {REQ}, t AS (SELECT ip, count(*) AS cnt FROM (SELECT * FROM req WHERE ip <> 0 ORDER BY event_id DESC LIMIT 5000) GROUP BY ip), {_cluster_ctes([ClusterSet(50, 16, 28, 0.5)])} SELECT * FROM found",
        "stream_ua_ttl": f"WITH {REQ}, cut AS (SELECT min(event_id) + (max(event_id) - min(event_id) + 1) // 2 AS c FROM events) SELECT DISTINCT ip, CASE WHEN user_agent = 'view' THEN 1 ELSE -1 END AS verdict FROM req, cut WHERE event_id >= c AND ip <> 0 AND user_agent IN ('view', 'click')",
        "window_survivors_time": f"WITH {_window_ctes(1 << 40)} SELECT * FROM win",
        "window_survivors_size": f"WITH {_window_ctes(200)} SELECT * FROM win",
        "window_ip_stats": f"WITH {_window_ctes(400)} SELECT ip, count(*) AS cnt, arg_max(ts, arrival) AS last FROM win GROUP BY ip",
        "window_cluster": f"WITH {_window_ctes(300)}, t AS (SELECT ip, count(*) AS cnt FROM win GROUP BY ip), {_cluster_ctes(_WINDOW_SETS)} SELECT * FROM found",
        "request_rates": f"{w} SELECT time_bucket(INTERVAL 10 SECOND, wall_ts, TIMESTAMP '1970-01-01') AS begin, concat_ws('.', ip >> 24, (ip >> 16) & 255, (ip >> 8) & 255, '0/24') AS subnet, count(*) / 10 AS rate FROM req WHERE ip <> 0 GROUP BY ALL",
        "request_rates_by_agent": f"{w} SELECT time_bucket(INTERVAL 3600 SECOND, wall_ts, TIMESTAMP '1970-01-01') AS begin, user_agent, count(*) / 3600 AS rate FROM req GROUP BY ALL",
        "jail_first_offense": "SELECT * FROM (VALUES (1, '10.0.0.0/24', 0::BIGINT, true), (1, '203.0.113.0/26', 0, true)) x(stage, cidr, minute, active)",
        "jail_escalate": "SELECT 3 AS stage, '10.0.0.0/24' AS cidr, 300::BIGINT AS minute, true AS active",
        "jail_absorb": "SELECT * FROM (VALUES (1, '10.0.0.0/24', 0::BIGINT, false), (2, '10.0.1.0/24', 20, true)) x(stage, cidr, minute, active)",
        "jail_prune": "SELECT 1 AS stage, '10.9.0.0/24' AS cidr, true AS active",
        "jail_stage_counts": "SELECT * FROM (VALUES (1, 0::BIGINT, 1::BIGINT), (2, 1, 1)) x(stage, active, prisoners)",
        "jail_active_meta": "SELECT '10.0.1.0/24' AS cidr, 2 AS stage, 260::BIGINT AS expires_minute",
    }
