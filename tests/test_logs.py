from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import parse_cidr, parse_ip
from rangewarden.functions.regexes import RegexError, alternatives, matches, required_literal, to_java
from rangewarden.functions.times import go_duration, parse_flexible, within
from rangewarden.operators.prefixes import address_counts
from rangewarden.sources import synth
from rangewarden.sources.logformat import DEFAULT_FORMAT, compile_format, parse_ips, parse_lines
from rangewarden.sources.readers import load_cidrs, load_patterns, parse_messages, read_log


def parse(spark, lines, fmt=DEFAULT_FORMAT):
    return parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), fmt).collect()


def line(status="200", size="5", ua="agent", ip="9.8.7.6", time="06/Feb/2025:10:00:00 +0200"):
    return f'- - - [{time}] "GET /x HTTP/1.1" {status} {size} - "{ua}" "{ip}"'


def test_status_and_bytes(spark):
    cases = [("200", 200, False), ("404", 404, False), ("2XX", 0, True), ("X00", 0, True), ("20", 0, True), ("2000", 0, True), ("999", 999, False), ("-", 0, False)]
    assert [(r["status"], r["bad_status"]) for r in parse(spark, [line(status=c[0]) for c in cases])] == [c[1:] for c in cases]
    cases = [("1234", 1234, False), ("0", 0, False), ("-", 0, False), ("12ab", 0, True), ("ab12", 0, True), ("007", 7, False), ("4294967297", 1, False), ("-5", 0, False)]
    assert [(r["bytes"], r["bad_bytes"]) for r in parse(spark, [line(size=c[0]) for c in cases])] == [c[1:] for c in cases]


def test_escapes(spark):
    for ua in (r"Mozilla \"Edge\" Browser", r"foo\\", r"a\"b\"c"):
        (r,) = parse(spark, [line(ua=ua)])
        assert (r["user_agent"], r["ip"]) == (ua, parse_ip("9.8.7.6"))
    (r,) = parse(spark, ['- - - [06/Feb/2025:10:00:00 +0000] "GET / H" 200 1 - "abc\\"def'])
    assert (r["user_agent"], r["ip"]) == ('abc\\"def', 0)


def test_times(spark):
    rows = parse(spark, [f"1.2.3.4 [{t}" for t in ("06/Feb/2025:10:00:00]", "06/Feb/2025:10:00:0]", "06/Feb/2025:10:00:00", "06/XXX/2025:10:00:00]", "06/Feb/2025:10:00:00 -0730]", "32/Jan/2025:25:00:00]")], "%h [%t]")
    ten = datetime(2025, 2, 6, 10)
    assert [r["wall_ts"] for r in rows] == [ten, None, ten, None, ten, datetime(2025, 2, 2, 1)]
    assert [r["offset_sec"] for r in rows] == [0, 0, 0, 0, -27000, 0]


def test_blank_and_carriage_return_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes((line() + "\r\n\n" + line(ip="::1") + "\n").encode())
    lines = read_log(spark, str(tmp_path / "a.log"))
    assert sorted(r["ip"] for r in parse_ips(lines).collect()) == [0, 0, parse_ip("9.8.7.6")]


def test_formats(spark):
    (r,) = parse(spark, ['1.2.3.4, 5.6.7.8 - - [06/Feb/2025:10:00:00 +0000] "POST /a/b?c HTTP/1.1" 200 - 77'], '%h, %^ %^ %^ [%t] "%r" %s %^ %b')
    assert (r["ip"], r["method"], r["uri"], r["bytes"]) == (parse_ip("1.2.3.4"), "POST", "/a/b?c", 77)
    for bad in ("", "%h %h", "%x %h", "%t", "%h %"):
        with pytest.raises(ValueError):
            compile_format(bad)


def test_live_messages(spark):
    good = '1.2.3.4 - - [06/Feb/2025:10:00:00 +0000] "PATCH /x HTTP/1.1" 200 12 "-" "ua \\"q\\""'
    cases = [good, None, "x", "::1 - - [a] ", "01.2.3.4 - -", "1.2.3.4 - - nothing", '1.2.3.4 - - [06/Feb/2025:10:00:00] "G / H" 1 2', "1.2.3.4 - - [06/Feb/2025:10:00:00 +0000] none"]
    rows = parse_messages(spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, message string")).orderBy("i").collect()
    assert [r["parse_error"] for r in rows] == [None, "no message", "no fields", "not IPv4", "bad address", "no time", "bad time", "no request"]
    assert (rows[0]["method"], rows[0]["status"], rows[0]["bytes"], rows[0]["user_agent"]) == ("PATCH", 200, 12, 'ua \\"q\\"')


def test_time_bounds(spark):
    rows = spark.createDataFrame([(1, datetime(2025, 1, 1, 6), 3600), (2, datetime(2025, 1, 1, 6), -25200), (3, datetime(2025, 1, 1, 5), 3600), (4, datetime(2025, 1, 1, 7), 0), (5, None, 0)], "id int, wall_ts timestamp_ntz, offset_sec int")
    ids = lambda **k: sorted(r[0] for r in rows.where(within(k.get("start"), k.get("end"))).select("id").collect())
    six, zoned = (datetime(2025, 1, 1, 6), False), (datetime(2025, 1, 1, 6, tzinfo=timezone(timedelta(hours=1))), True)
    assert ids(start=six) == [1, 2, 4]
    assert ids(end=six) == [1, 2, 3, 5]
    assert ids(start=zoned) == [1, 2, 4]
    assert ids(end=zoned) == [1, 3, 5]


def test_regexes(spark):
    assert to_java("a$[[:alpha:]]") == r"a\z[\p{Alpha}]"
    assert to_java("(?m)a$") == "(?m)a$"
    for bad in (r"(a)\1", "(?=a)", "a++", "(?U)a*", "[a", "(", r"\C"):
        with pytest.raises(RegexError):
            to_java(bad)
    assert alternatives(r"a\.b|c") == ["a.b", "c"] and alternatives("a+") is None
    assert required_literal("abc.*de") == "abc" and required_literal("ab?cd") is None
    df = spark.createDataFrame([("",), ("abc\n",), ("xabc",), (None,)], "v string")
    assert [r[0] for r in df.where(matches(F.col("v"), "abc$")).collect()] == ["xabc"]
    assert df.where(matches(F.col("v"), ".*")).count() == 2


def test_small_parsers():
    assert go_duration("1h30m") == timedelta(minutes=90) and go_duration("250ms") == timedelta(milliseconds=250)
    with pytest.raises(ValueError):
        go_duration("2 days")
    assert parse_flexible("2025-01-02T03:04:05+01:00")[1] and not parse_flexible("2025-01-02")[1]


def test_list_files(tmp_path):
    (tmp_path / "l").write_text("# head\n10.0.0.0/8 # x\n\n1.2.3.4/32\n")
    assert load_cidrs(str(tmp_path / "l")) == ["10.0.0.0/8", "1.2.3.4/32"]
    for bad in ("::1/64", "1.2.3.4", "1.2.3.4/33", "::ffff:1.2.3.0/120"):
        (tmp_path / "b").write_text(f"10.0.0.0/8\n{bad}\n")
        with pytest.raises(ValueError, match=":2:"):
            load_cidrs(str(tmp_path / "b"))
    (tmp_path / "u").write_text("sqlmap/1.7.2#stable\n")
    assert load_patterns(str(tmp_path / "u")) == ["sqlmap/1.7.2"]


def test_a_line_meets_its_pattern_once(spark):
    lines = spark.createDataFrame([(line(),)], "value string")
    counted = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    assert counted(parse_ips(lines)) == counted(address_counts(parse_ips(lines))) == 1
    requests = parse_lines(lines)
    kept = requests.where(matches(F.col("user_agent"), "age") & (F.col("ip") != 0))
    assert counted(address_counts(kept)) == 1
    # The size's leading zeros are another pattern.
    assert counted(requests) <= 3


def test_long_lines_are_dropped(spark, tmp_path):
    (tmp_path / "a.log").write_text(line() + "\n" + line(ua="x" * 5000) + "\n")
    assert read_log(spark, str(tmp_path / "a.log")).count() == 2 and read_log(spark, str(tmp_path / "a.log"), 5000).count() == 1


def test_invented_logs_have_their_shares(spark):
    rows = parse_lines(synth.synthetic_log(spark, 40_000, 7), synth.FORMAT).collect()
    assert len(rows) == 40_000 and all(r["ip"] and r["method"] == "GET" and 1800 <= r["bytes"] <= 8800 for r in rows)
    share = lambda test: sum(map(test, rows)) / len(rows)
    for net, want in synth.HOT.items():
        assert abs(share(lambda r, net=net: r["ip"] >> 16 == parse_ip(net.split("/")[0]) >> 16) - want) < 0.004
    for agent, want in synth.AGENTS.items():
        assert abs(share(lambda r, agent=agent: r["user_agent"] == agent) - want) < 0.012
    assert abs(share(lambda r: r["status"] == 200) - 0.6) < 0.012 and abs(share(lambda r: r["uri"] == "/fake-endpoint-1") - 1 / sum(k**-1.1 for k in range(1, 101))) < 0.012
    assert not any(s <= r["ip"] <= e for r in rows for s, e, _ in map(parse_cidr, synth.RESERVED)) and max(r["ip"] for r in rows) < 224 << 24
    times = [r["wall_ts"] for r in rows]
    assert max(times) - min(times) > timedelta(hours=71) and all(abs((t - times[0]).total_seconds() - i * synth.SPAN_SECONDS / len(rows)) <= 601 for i, t in enumerate(times))
    again = synth.synthetic_log(spark, 50, 7).collect()
    assert again == synth.synthetic_log(spark, 50, 7).collect() != synth.synthetic_log(spark, 50, 8).collect()


def test_random_addresses(spark):
    for cidr, n in (("10.0.0.0/29", 6), ("10.0.0.4/31", 2), ("10.0.0.9/32", 1)):
        start, end, _ = parse_cidr(cidr)
        got = {r["ip"] for r in synth.random_addresses(spark, cidr, 200).collect()}
        assert len(got) == n and min(got) >= start and max(got) <= end
    with pytest.raises(ValueError):
        synth.random_addresses(spark, "nothing", 1)
