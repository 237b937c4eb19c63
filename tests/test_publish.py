import random
import tracemalloc
from datetime import datetime, timezone

import pytest

from rangewarden.functions.ipcalc import format_cidr, parse_cidr
from rangewarden.operators.jail import ban_file, load_jail
from rangewarden.plans import static
from rangewarden.plans.config import Config, from_flags
from rangewarden.shipping import shared_dir

NOW = datetime(2025, 3, 1, tzinfo=timezone.utc)


def report_of(cidrs, white=()):
    rows = [{"cidr": c, "requests": 1, "percentage": 0.0} for c in cidrs]
    return {"tries": [{"clusters": [{"set": {"use_for_jail": True}, "merged_ranges": rows}]}], "ua_whitelist_ips": list(white), "ua_blacklist_ips": [], "warnings": [], "errors": []}


def config_of(folder):
    return Config(jail_file=str(folder / "jail.json"), ban_file=str(folder / "ban.txt"))


def test_bans_that_a_whitelist_cuts_finely_stay_off_the_driver(spark, tmp_path):
    rng = random.Random(1)
    white = [format_cidr((10 << 24) + rng.randrange(1 << 24), 32) for _ in range(4000)]
    static.publish(spark, config_of(tmp_path), report_of(["10.0.0.0/16"], white[:3]), {"whitelist": [], "blacklist": []}, NOW)  # loads what is loaded once
    config = config_of(tmp_path)
    tracemalloc.start()
    static.publish(spark, config, report_of(["10.0.0.0/8"], white), {"whitelist": [], "blacklist": ["10.0.0.0/9"]}, NOW)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    text = (tmp_path / "ban.txt").read_text()
    lines = [x for x in text.splitlines() if not x.startswith("#")]
    assert len(lines) > 60_000 and peak / len(lines) < 60  # bytes a line
    left = static.compose(spark, ["10.0.0.0/8"], ["10.0.0.0/9"], white)
    assert text == ban_file(*left, NOW)
    covered = sum(1 << (32 - parse_cidr(c)[2]) for c in left[0])
    assert covered == (1 << 24) - len(set(white))


@pytest.mark.parametrize("rows", [3, 10_000])
def test_listed_addresses_as_table_and_as_lists(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(static, "PLAN_ROWS", rows, raising=False)  # longer lists are files
    rng = random.Random(2)
    address = lambda: (10 << 24) + rng.randrange(1 << 12)
    white, black = sorted({address() for _ in range(40)}), sorted({address() for _ in range(300)})
    ranges = ["10.0.2.0/24", "10.0.9.0/30", "10.0.0.0/25", "172.16.0.0/12"]
    lists = {"whitelist": ["10.0.2.0/25", "10.0.9.0/24", "172.20.0.0/14"], "blacklist": ["not-a-range", "10.0.4.7/22", "172.16.0.0/12", "9.9.9.9/32", "10.0.2.0/26"]}
    texts = lambda ips: [format_cidr(x, 32) for x in ips]
    for name in ("lists", "table"):
        (tmp_path / name).mkdir()
    report = report_of(ranges, texts(white)) | {"ua_blacklist_ips": texts(black)}
    static.publish(spark, config_of(tmp_path / "lists"), report, lists, NOW)
    listed = spark.createDataFrame([(v, x) for v, ips in ((1, white), (-1, black)) for x in rng.sample(ips, len(ips))], "verdict int, ip long").repartition(3)
    static.publish(spark, config_of(tmp_path / "table"), report_of(ranges), lists, NOW, listed)
    made = [(tmp_path / name / "ban.txt").read_text() for name in ("lists", "table")]
    jail = load_jail(str(tmp_path / "table" / "jail.json"))
    assert jail == load_jail(str(tmp_path / "lists" / "jail.json")) and "10.0.9.0/30" not in jail.all_cidrs
    bans, entries = static.compose(spark, jail.all_cidrs, lists["blacklist"], lists["whitelist"] + texts(white))
    assert made[0] == made[1] == ban_file(bans, entries, NOW) and "not-a-range" in entries and "172.24.0.0/13" in bans


def test_static_report_keeps_its_lists_and_no_scratch(spark, tmp_path):
    import os

    row = lambda ip, ua: f'{ip} - - [06/Feb/2025:10:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "{ua}"'
    (tmp_path / "a.log").write_text("\n".join(row(f"10.0.0.{i}", ("Good", "Bad", "Browser")[i % 3]) for i in range(30)) + "\n")
    (tmp_path / "uaw.txt").write_text("good\n")
    (tmp_path / "uab.txt").write_text("bad\n")
    config = from_flags("static", log_file=str(tmp_path / "a.log"), log_format='%h %^ %^ [%t] "%r" %s %b "%^" "%u"', cluster_sets=["30,8,24,0.9"], ua_whitelist=str(tmp_path / "uaw.txt"), ua_blacklist=str(tmp_path / "uab.txt"), jail_file=str(tmp_path / "jail.json"), ban_file=str(tmp_path / "ban.txt"))
    report = static.run_static(spark, config, NOW)
    want = {k: [f"10.0.0.{i}/32" for i in range(j, 30, 3)] for j, k in enumerate(("ua_whitelist_ips", "ua_blacklist_ips"))}
    assert {k: report[k] for k in want} == want
    assert load_jail(config.jail_file).all_cidrs == want["ua_blacklist_ips"]
    assert [x for x in (tmp_path / "ban.txt").read_text().splitlines() if x[0] != "#"] == want["ua_blacklist_ips"]
    assert not [x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("scratch-")]
