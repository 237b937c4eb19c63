import json
from datetime import datetime, timedelta, timezone

import pytest

from rangewarden.operators.clusters import ClusterSet
from rangewarden.plans.config import ConfigError, Trie, from_flags, from_toml, quoted
from rangewarden.plans.report import grid_text, metrics, to_compact_json, to_json, to_plain, to_view
from rangewarden.plans.static import analyse, run_static
from rangewarden.streaming.live import LiveEngine, serve

TOML = """
[global]
jailFile = "{d}/jail.json"
banFile = "{d}/ban.txt"
whitelist = "{d}/white.txt"
blacklist = "{d}/black.txt"
userAgentWhitelist = "{d}/uaw.txt"
userAgentBlacklist = "{d}/uab.txt"
[static]
logFile = "{d}/access.log"
logFormat = '%h %^ %^ [%t] "%r" %s %b "%^" "%u"'
plotPath = "{d}/map.html"
[static.all]
cidrRanges = ["10.50.0.0/16", "172.16.0.0/16"]
clusterArgSets = [[300, 8, 24, 0.9]]
useForJail = [true]
[static.api]
endpointRegex = "^/api"
clusterArgSets = [[100, 8, 24, 0.9]]
[live]
port = "5044"
[live.hot]
slidingWindowMaxTime = "1h"
slidingWindowMaxSize = 1000
clusterArgSets = [[200, 24, 30, 0.5]]
useForJail = [true]
"""


@pytest.fixture
def folder(tmp_path):
    row = lambda ip, ua, uri: f'{ip} - - [06/Feb/2025:10:00:00 +0000] "GET {uri} HTTP/1.1" 200 5 "-" "{ua}"'
    lines = [row(f"10.50.{i // 256}.{i % 256}", "Browser", "/pages") for i in range(2000)]
    lines += [row(f"192.168.{i // 256}.{i % 256}", "Googlebot", "/api/x") for i in range(1500)]
    lines += [row(f"172.16.0.{i % 256}", "BadBot", "/wp") for i in range(500)] + [row(f"203.0.0.{i}", "Browser", "/api/y") for i in range(200)]
    (tmp_path / "access.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "white.txt").write_text("203.0.0.0/24\n203.0.113.0/25\n")
    (tmp_path / "black.txt").write_text("198.51.100.0/24\n203.0.113.0/24\n")
    (tmp_path / "uaw.txt").write_text("googlebot\n")
    (tmp_path / "uab.txt").write_text("BadBot\n")
    return tmp_path


def test_static(spark, folder):
    config = from_toml(TOML.format(d=folder))
    report = run_static(spark, config, datetime(2025, 3, 1, tzinfo=timezone.utc))
    tries = {t["name"]: t for t in report["tries"]}
    assert report["general"]["total_requests"] == 4200
    assert tries["all"]["stats"]["total_requests_after_filtering"] == 2700 and tries["all"]["stats"]["ua_whitelisted"] == 1500
    assert tries["api"]["stats"]["total_requests_after_filtering"] == 200
    assert [r["requests"] for r in tries["all"]["cidr_ranges"]] == [2000, 500]
    bans = (folder / "ban.txt").read_text()
    assert "198.51.100.0/24" in bans and "203.0.113.128/25" in bans and "203.0.113.0/24" not in bans
    assert not any(x.startswith(("203.0.0.", "192.168.")) for x in bans.splitlines())
    assert "10.50." in bans and "172.16.0." in bans
    assert json.loads(to_json(report)) == json.loads(to_compact_json(report)) and "== all ==" in to_plain(report)
    assert "<canvas" in (folder / "map.html").read_text()


def test_addresses_alone_agree_with_the_full_path(spark, folder):
    plain = from_flags("static", log_file=str(folder / "access.log"), log_format='%h %^ %^ [%t] "%r"', cluster_sets=["300,8,24,0.9"])
    full = from_flags("static", log_file=str(folder / "access.log"), log_format='%h %^ %^ [%t] "%r"', cluster_sets=["300,8,24,0.9"], start="2000-01-01")
    a, b = run_static(spark, plain), run_static(spark, full)
    assert a["tries"][0]["clusters"] == b["tries"][0]["clusters"] and a["tries"][0]["clusters"][0]["merged_ranges"]


def test_empty_log(spark, tmp_path):
    (tmp_path / "e.log").write_text("")
    report = run_static(spark, from_flags("static", log_file=str(tmp_path / "e.log")))
    assert report["warnings"][0]["type"] == "empty_logfile"


def test_view_as_text(spark, folder):
    report = run_static(spark, from_toml(TOML.format(d=folder)), datetime(2025, 3, 1, tzinfo=timezone.utc), grids=True)
    assert sum(n for *_, n in report["grids"]["all"]) == 2700 and sum(n for *_, n in report["grids"]["api"]) == 200
    pages = to_view(report, report["grids"])
    assert "=== all ===" in pages and "=== api ===" in pages and "=== all ===" not in to_view(report, report["grids"], "api")
    rows = grid_text([(0, 0, 1), (8, 255, 100)]).splitlines()
    assert len(rows) == 34 and rows[1].startswith("   0 |") and rows[1][6] != " " and rows[2].endswith("@|") and rows[3].strip("16 |") == ""


def test_warnings(spark, folder):
    report = run_static(spark, from_toml(TOML.format(d=folder)), datetime(2025, 3, 1, tzinfo=timezone.utc))
    kinds = {w["type"] for w in report["warnings"]}
    assert {"info", "blacklist_applied", "jail_update"} <= kinds and "Warning: info" not in to_plain(report)
    rows = spark.createDataFrame([(1,)], "ip long")
    assert analyse(spark, rows, [Trie("a", sets=(ClusterSet(1, 9, 3, 0.1), ClusterSet(1, 30, 40, 0.1)))])["errors"][1]["type"] == "invalid_depth_params"


def test_configs_tell_all_that_is_wrong(tmp_path):
    bad = '[global]\nwhitelist = "/nowhere"\nfoo = "x"\n[static]\nlogFile = "/none"\n[static.a]\nclusterArgSets = [[1, 9, 3, 0.1], [1, 2]]\nuseForJail = [true]\nuseragentRegex = "(?=x)"\n'
    with pytest.raises(ConfigError) as e:
        from_toml(bad).validate("static")
    text = str(e.value)
    assert text.startswith("configuration errors (7):\n1. ")
    for part in ('[global] invalid whitelist "/nowhere": want a file', '[global] unknown key "foo" (want: banFile,', "does not exist", "minDepth <= maxDepth", "clusterArgSets row 1", "useForJail", "look-around"):
        assert part in text
    with pytest.raises(ConfigError, match="invalid format .*want text or json"):
        from_toml(f'[log]\nformat = "xml"\n[static]\nlogFile = "{tmp_path}"\n[static.a]\n').validate("static")
    with pytest.raises(ConfigError):
        from_toml("[other]\n")
    with pytest.raises(ConfigError, match="banFile"):
        from_flags("live", port="1").validate("live")


@pytest.mark.parametrize("text", ["static = 5", "[static]\nlogFile = 3", "[static.a]\nuseForJail = true", "[static.a]\nuseForJail = [1]", "[live.a]\nslidingWindowMaxTime = 'soon'", "[live]\ntopTalkers = 'x'", "[static.a]\nclusterArgSets = 1", "[global]\nbanFile = 1", "[live.a]\nslidingWindowMaxSize = 1.5", "[log]\nlevel = 1"])
def test_wrong_types_fail_at_once(text):
    with pytest.raises(ConfigError, match="invalid"):
        from_toml(text)


def test_messages_stay_on_their_lines():
    assert quoted("a\nb") == '"a\\nb"' and quoted("é" * 100) == '"' + "é" * 60 + '\u2026"' and quoted(True) == '"true"'
    e = ConfigError(["b\x07\n2. forged", "a"])
    assert str(e).splitlines() == ["configuration errors (2):", "1. a", "2. b\\x07\\n2. forged"]


def test_log_settings_of_a_file():
    c = from_toml('[log]\nlevel = "WARN"\nformat = "json"\n[static]\nmaxLineLength = 10\n')
    assert (c.log_level, c.log_form, c.max_line_length) == ("WARN", "json", 10) and from_toml("").max_line_length == 2 << 20


def message(ip, at, ua="Browser"):
    return (f'{ip} - - [{at.strftime("%d/%b/%Y:%H:%M:%S")} +0000] "GET /x HTTP/1.1" 200 5 "-" "{ua}"',)


def test_live(spark, folder):
    now = [datetime(2025, 2, 6, 12, tzinfo=timezone.utc)]
    engine = LiveEngine(spark, from_toml(TOML.format(d=folder)), str(folder / "state"), clock=lambda: now[0])
    batch = lambda xs: spark.createDataFrame(xs, "message string")
    hot = [message(f"10.5.5.{i}", now[0]) for i in range(256)]
    engine.process(batch(hot + [message(f"77.{i}.1.1", now[0]) for i in range(20)] + [("junk",)]), 0)
    assert engine.jail.all_cidrs == ["10.5.5.0/24"] and engine.snapshot["windows"][0]["requests"] == 276
    assert engine.snapshot["ingest"]["parse_errors"] == 1
    engine.process(batch([message("9.9.9.9", now[0], "BadBot"), message("8.8.8.8", now[0], "Googlebot")]), 1)
    assert "9.9.9.9/32" in engine.jail.all_cidrs and engine.snapshot["ua_ips"] == {"whitelist": 1, "blacklist": 1}
    engine.process(batch([message("9.9.9.9", now[0], "BadBot"), message("8.8.8.8", now[0], "Googlebot")]), 1)
    assert engine.snapshot["windows"][0]["requests"] == 277
    assert not engine.heartbeat()
    now[0] += timedelta(hours=2)
    assert engine.heartbeat() and "10.5.5.0/24" not in (folder / "ban.txt").read_text()
    engine.process(batch([message("1.1.1.1", now[0])]), 2)
    assert engine.snapshot["windows"][0]["requests"] == 1
    assert 'rangewarden_window_requests{window="hot"} 1' in metrics(engine.snapshot)


def bans(folder):
    return [x for x in (folder / "ban.txt").read_text().splitlines() if not x.startswith("#")]


def test_live_goes_on_after_a_restart(spark, folder):
    now = datetime(2025, 2, 6, 12, tzinfo=timezone.utc)
    batch = lambda xs: spark.createDataFrame([message(*x) for x in xs], "message string")
    one = batch([(f"10.5.5.{i}", now) for i in range(0, 256, 2)] + [("9.9.9.9", now, "BadBot"), ("8.8.8.8", now, "Googlebot")])
    two = batch([(f"10.5.5.{i}", now) for i in range(1, 256, 2)])
    config = lambda: from_toml(TOML.format(d=folder))
    engine = lambda name: LiveEngine(spark, config(), str(folder / name), clock=lambda: now)
    first = engine("state")
    first.process(one, 0)
    second = engine("state")  # after the loss of the first
    assert second.state == first.state and second.counters["requests"] == 130
    second.process(two, 1)
    want, rows = bans(folder), sorted(map(tuple, second.window_rows("hot").select("ts", "ip").collect()))
    assert "10.5.5.0/24" in want and "9.9.9.9/32" in want and len(rows) == 257
    third = engine("state")
    third.process(two, 1)  # the stream runs its last batch again
    assert bans(folder) == want and sorted(map(tuple, third.window_rows("hot").select("ts", "ip").collect())) == rows
    assert third.state.iterations == 2 and third.counters == second.counters
    third.process(batch([]), 2)
    kept = {p.name for p in (folder / "state" / "window-hot").iterdir() if p.is_dir()}
    assert len(kept) == 2 and third.snapshot["windows"][0]["requests"] == 257


def test_live_counts_what_waits(spark, folder):
    class Source:
        class stats:
            batches, events, errors, last_batch = 3, 10, 1, 5.0

    engine = LiveEngine(spark, from_toml(TOML.format(d=folder)), str(folder / "state"))
    engine.attach(Source)
    engine.process(spark.createDataFrame([message("1.1.1.1", datetime.now(timezone.utc)), ("junk",)], "message string"), 0)
    assert engine.snapshot["ingest"]["queue_depth"] == 8 and "rangewarden_source_queue_depth 8" in metrics(engine.snapshot)


def test_live_stream_and_http(spark, folder):
    import urllib.error
    import urllib.request

    from rangewarden.sources.readers import stream_log

    at = datetime(2025, 2, 6, 12, tzinfo=timezone.utc)
    (folder / "in").mkdir()
    (folder / "in" / "a.log").write_text("\n".join(message(f"10.5.5.{i}", at)[0] for i in range(256)) + "\n")
    engine = LiveEngine(spark, from_toml(TOML.format(d=folder)), str(folder / "state"), clock=lambda: at)
    server = serve(engine, "127.0.0.1:0")
    url = f"http://127.0.0.1:{server.server_address[1]}"
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"{url}/bans")
    assert e.value.code == 503 and e.value.headers["Retry-After"] == "5"
    engine.start(stream_log(spark, str(folder / "in")), str(folder / "cp"), available_now=True).awaitTermination()
    assert "10.5.5.0/24" in urllib.request.urlopen(f"{url}/bans").read().decode()
    assert json.loads(urllib.request.urlopen(f"{url}/stats").read())["jail"]["active"] == 1
    server.shutdown()
