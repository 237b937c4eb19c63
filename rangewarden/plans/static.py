"""Analysis of bounded logs: many tries over one parse, reports, jail and ban lists."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import format_cidr, parse_cidr
from rangewarden.operators import clusters, filters, prefixes, ranges
from rangewarden.operators.grids import grid
from rangewarden.operators.jail import ban_parts, load_jail, save_jail, write_atomic
from rangewarden.plans.config import Config, Trie
from rangewarden.shipping import scratch, share, shared_lines
from rangewarden.sources.logformat import parse_ips, parse_lines
from rangewarden.sources.readers import read_log


def _pass(trie: Trie) -> Column:
    keep = filters.request_filter(trie.user_agent_regex, trie.endpoint_regex, trie.start, trie.end)
    return F.lit(True) if keep is None else keep


#: Stands in a trie's place for all lines, whatever they hold.
ALL = -1


def trie_counts(requests: DataFrame, tries: list[Trie]) -> DataFrame:
    """All tries over one scan: for each trie, address and verdict (invalid addresses too) the requests that pass its filter.

    A request becomes one row with the numbers of the tries it passes, and partial sums travel from there. The trie
    ALL has one row for all requests, with those whose status (bad_status) and size (bad_bytes) is malformed.
    """
    numbers = F.filter(F.array(F.lit(ALL), *[F.when(_pass(t), F.lit(i)) for i, t in enumerate(tries)]), lambda x: x.isNotNull())
    own = lambda c: F.col(c) if c in requests.columns else F.lit(None)
    each = requests.select(F.explode(numbers).alias("trie"), "ip", own("verdict").cast("int").alias("verdict"), *[F.coalesce(own(c).cast("int"), F.lit(0)).alias(c) for c in ("bad_status", "bad_bytes")])
    of_trie = lambda c: F.when(F.col("trie") != ALL, F.col(c)).alias(c)
    bad = [F.sum(F.when(F.col("trie") == ALL, F.col(c)).otherwise(0)).alias(c) for c in ("bad_status", "bad_bytes")]
    return each.groupBy("trie", of_trie("ip"), of_trie("verdict")).agg(F.count("*").alias("cnt"), *bad)


def analyse(spark: SparkSession, requests: DataFrame, tries: list[Trie], agents: DataFrame | None = None, plot: bool = False, grids: bool = False, listed_to: str | None = None) -> dict:
    """The report: for each trie its counters, ranges and clusters, detected and merged. What reaches the driver are counters, found ranges and listed addresses.

    plot: also the requests of each /16, as cells. grids: also those of each trie, by its name. listed_to: where the
    addresses of listed agents become a table (verdict, ip); then they don't reach the driver, and the report has none.
    """
    if agents is not None:
        requests = filters.with_verdict(requests, agents)
    asked_for = [*tries, Trie("")] if plot else tries
    every = trie_counts(requests, asked_for).persist()
    try:
        n = lambda c: F.coalesce(F.sum(F.when(c, F.col("cnt")).otherwise(0)), F.lit(0)).cast("long")
        valid, white = F.col("ip") != 0, F.col("verdict").eqNullSafe(1)
        of_trie = every.where(F.col("trie") != ALL)
        stats = {r["trie"]: r for r in every.groupBy("trie").agg(n(~valid).alias("invalid"), n(valid & white).alias("white"), n(valid & F.col("verdict").eqNullSafe(-1)).alias("black"), n(valid & ~white).alias("total"), F.countDistinct(F.when(valid & ~white, F.col("ip"))).alias("unique"), F.sum("cnt").alias("lines"), F.sum("bad_status").alias("bad_status"), F.sum("bad_bytes").alias("bad_bytes")).collect()}
        counts = of_trie.where(valid & ~white).groupBy("trie", "ip").agg(F.sum("cnt").alias("cnt"))
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        sets = [(i, k, s) for i, t in enumerate(tries) for k, s in enumerate(t.sets) if 0 <= s.min_depth <= s.max_depth <= 32]
        errors = [{"type": "invalid_depth_params", "message": f"{t.name}: depths {s.min_depth} to {s.max_depth} are not within 0 to 32, the set is left out"} for t in tries for s in t.sets if not 0 <= s.min_depth <= s.max_depth <= 32]
        if sets:
            for r in clusters.detect(counts, [s for _, _, s in sets], "trie", owners=[i for i, _, _ in sets]).orderBy("set_id", "start", "len").collect():
                found.setdefault(sets[r["set_id"]][:2], []).append((r["start"], r["len"]))
        merged = {k: merge(v) for k, v in found.items()}
        asked = {(i, *r) for (i, _), v in [*found.items(), *merged.items()] for r in v} | {(i, b[0], b[2]) for i, t in enumerate(tries) for x in t.ranges if (b := parse_cidr(x))}
        held = _requests(spark, counts, asked)
        out = []
        for i, t in enumerate(tries):
            s = stats.get(i)
            total = s["total"] if s else 0
            row = lambda r, i=i, total=total: {"cidr": format_cidr(*r), "requests": held.get((i, *r), 0), "percentage": held.get((i, *r), 0) / total * 100 if total else 0.0}
            warnings = [{"type": "invalid_cidr", "message": f"{x} is not an IPv4 range"} for x in t.ranges if parse_cidr(x) is None]
            if s and s["invalid"]:
                warnings.append({"type": "invalid_ips_skipped", "message": f"{s['invalid']} requests without a valid address"})
            if not total and (t.start or t.end):
                warnings.append({"type": "time_filter_no_results", "message": f"no request of {t.name} lies within its times"})
            out.append({
                "name": t.name, "parameters": parameters(t), "stats": {"total_requests_after_filtering": total, "unique_ips": s["unique"] if s else 0, "skipped_invalid_ips": s["invalid"] if s else 0, "ua_whitelisted": s["white"] if s else 0, "ua_blacklisted": s["black"] if s else 0},
                "cidr_ranges": [row((b[0], b[2])) for x in t.ranges if (b := parse_cidr(x))],
                "clusters": [{"set": {"min_size": c.min_size, "min_depth": c.min_depth, "max_depth": c.max_depth, "mean_subnet_difference": c.mean_subnet_difference, "use_for_jail": c.use_for_jail}, "detected_ranges": [row(r) for r in found.get((i, k), [])], "merged_ranges": [row(r) for r in merged.get((i, k), [])]} for k, c in enumerate(t.sets)],
                "warnings": warnings,
            })
        addresses = of_trie.where(valid & F.col("verdict").isin(1, -1)).select("verdict", "ip").distinct()
        if listed_to and agents is not None:
            addresses.write.parquet(listed_to)
        lists = {v: _listed(addresses, v) if agents is not None and not listed_to else [] for v in (1, -1)}
        cells = [(r["o1"], r["o2"], r["n"]) for r in grid(of_trie.where(valid & (F.col("trie") == len(tries))).select("ip", "cnt")).collect()] if plot else []
        by_trie: dict[str, list[tuple[int, int, int]]] = {t.name: [] for t in tries}
        for r in grid(counts.where(F.col("trie") < len(tries)), "trie").collect() if grids else []:  # 65,536 cells a trie at most
            by_trie[tries[r["trie"]].name].append((r["o1"], r["o2"], r["n"]))
    finally:
        every.unpersist()
    out.sort(key=lambda x: x["name"])
    whole = stats.get(ALL)
    lines = {"total_requests": whole["lines"], "bad_status": whole["bad_status"], "bad_bytes": whole["bad_bytes"]} if whole else {"total_requests": 0, "bad_status": 0, "bad_bytes": 0}
    return {"general": {"unique_ips": max((x["stats"]["unique_ips"] for x in out), default=0)}, "tries": out, "ua_whitelist_ips": lists[1], "ua_blacklist_ips": lists[-1], "lines": lines, "cells": cells, "grids": by_trie, "errors": errors}


def _listed(addresses: DataFrame, verdict: int) -> list[str]:
    """Addresses (verdict, ip) of one verdict in their order, as Arrow columns: rows of Python objects take ten times their memory."""
    got = addresses.where(F.col("verdict") == verdict).select("ip").orderBy("ip").toArrow()
    return [format_cidr(x, 32) for b in got.column("ip").chunks for x in b.tolist()]


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """MRG-1 over one set's few ranges, which are on the driver already."""
    kept, reach = [], -1
    for start, length in sorted(set(found)):
        end = start + (1 << (32 - length)) - 1
        if end > reach:
            kept.append((start, length))
            reach = end
    return ranges.merge_siblings(kept)


def _requests(spark: SparkSession, counts: DataFrame, asked: set[tuple[int, int, int]]) -> dict[tuple[int, int, int], int]:
    """Requests of (trie, start, len), in one pass for all tries."""
    if not asked:
        return {}
    frame = spark.createDataFrame(sorted(asked), "trie int, start long, len int")
    return {(r["trie"], r["start"], r["len"]): r["n"] for r in prefixes.range_counts(counts, frame, "trie").collect()}


def parameters(t: Trie) -> dict:
    when = lambda b: b[0].isoformat() if b else None
    return {k: v for k, v in {"useragent_regex": t.user_agent_regex, "endpoint_regex": t.endpoint_regex, "start_time": when(t.start), "end_time": when(t.end)}.items() if v}


def active_filters(p: dict, lists: dict[str, list[str]]) -> list[str]:
    """FLT-11: what is in force, in words."""
    names = {"useragent_regex": "User-Agent regex", "endpoint_regex": "Endpoint regex", "start_time": "Start time", "end_time": "End time"}
    counted = {"whitelist": "CIDR whitelist", "blacklist": "CIDR blacklist", "ua_whitelist": "User-Agent whitelist", "ua_blacklist": "User-Agent blacklist"}
    return [f"{names[k]}: {p[k]}" for k in names if k in p] + [f"{counted[k]}: {len(v):,} entries" for k, v in lists.items() if v]


def run_static(spark: SparkSession, config: Config, now: datetime | None = None, grids: bool = False) -> dict:
    """SRC to JAIL-9 for a configuration: checks it, analyses its log, updates jail and ban file, returns the report."""
    config.validate("static")
    with scratch(spark) as folder:
        return _run_static(spark, config, now, grids, f"{folder}/listed")


def _run_static(spark: SparkSession, config: Config, now: datetime | None, grids: bool, listed_to: str) -> dict:
    began, now, lists = time.time(), now or datetime.now(timezone.utc), config.lists()
    lines = read_log(spark, config.log_file, config.max_line_length)
    listed = lists["ua_whitelist"] or lists["ua_blacklist"]
    plain = not listed and not any(t.filtered for t in config.tries)
    requests = parse_ips(lines, config.log_format) if plain else parse_lines(lines, config.log_format)
    agents = filters.user_agent_list(spark, lists["ua_whitelist"], lists["ua_blacklist"]) if listed else None
    warnings: list[dict] = []
    report = analyse(spark, requests, config.tries, agents, plot=bool(config.plot_path), grids=grids, listed_to=listed_to)
    counted, cells = report.pop("lines"), report.pop("cells")
    if not grids:
        report.pop("grids")
    total = counted["total_requests"]
    if not total:
        return {"general": {"log_file": config.log_file, "total_requests": 0, "unique_ips": 0, "generated_at": now.isoformat()}, "tries": [], "warnings": [{"type": "empty_logfile", "message": "the log has no lines"}], "errors": []}
    if counted["bad_status"] or counted["bad_bytes"]:
        warnings.append({"type": "malformed_field", "message": f"{counted['bad_status']} malformed statuses, {counted['bad_bytes']} malformed sizes"})
    report["general"] |= {"log_file": config.log_file, "total_requests": total, "generated_at": now.isoformat(), "seconds": round(time.time() - began, 3)}
    report["general"]["active_filters"] = [active_filters(parameters(t), lists) for t in config.tries]
    if not config.tries:
        warnings.append({"type": "config_warning", "message": "no trie is configured"})
    report["warnings"] = warnings + [w for t in report["tries"] for w in t["warnings"]]
    if config.plot_path:
        from rangewarden.plans.report import heatmap_html

        write_atomic(config.plot_path, heatmap_html(cells))
        report["warnings"].append({"type": "info", "message": f"map of the traffic written to {config.plot_path}"})
    if config.jail_file and config.ban_file:
        publish(spark, config, report, lists, now, spark.read.parquet(listed_to) if listed else None)
    if listed:
        addresses = spark.read.parquet(listed_to)
        report |= {"ua_whitelist_ips": _listed(addresses, 1), "ua_blacklist_ips": _listed(addresses, -1)}
    return report


def publish(spark: SparkSession, config: Config, report: dict, lists: dict[str, list[str]], now: datetime, listed: DataFrame | None = None) -> None:
    """JAIL-9: detected ranges of the jail's sets, less what is whitelisted as a whole, and the listed agents' addresses go to jail; bans and blacklist, less the whitelist, to the ban file.

    Without anything to jail the jail stays as it is, expired bans included. listed: the table (verdict, ip) of analyse().
    What the whitelist leaves of the bans may be many times the bans, so it goes to the ban file through the shared folder.
    """
    with scratch(spark) as folder:
        _publish(spark, config, report, lists, now, listed, folder)


def _publish(spark: SparkSession, config: Config, report: dict, lists: dict[str, list[str]], now: datetime, listed: DataFrame | None, folder: str) -> None:
    jailed = [r["cidr"] for t in report["tries"] for s in t["clusters"] if s["set"]["use_for_jail"] for r in s["merged_ranges"]]
    fixed = lists["whitelist"] + report.get("ua_whitelist_ips", [])
    white = ranges.parsed(_frame(spark, fixed, f"{folder}/white")).select("start", "len") if fixed or listed is not None else None
    if listed is not None:
        white = white.union(listed.where("verdict = 1").select("ip", F.lit(32)))
    kept = ranges.drop_fully_whitelisted(_frame(spark, jailed, f"{folder}/jailed"), white).orderBy("ord").toArrow().column("cidr").to_pylist() if jailed and white is not None else jailed
    if len(kept) < len(jailed):
        report["warnings"].append({"type": "whitelist_applied", "message": f"{len(jailed) - len(kept)} ranges are whitelisted"})
    add = kept + report.get("ua_blacklist_ips", []) + (_listed(listed, -1) if listed is not None else [])
    jail = load_jail(config.jail_file)
    if add:
        report["errors"] += [{"type": "jail_update", "message": m} for m in jail.update(add, now)]
        save_jail(jail, config.jail_file)
        report["warnings"].append({"type": "jail_update", "message": f"{len(add)} ranges jailed"})
    active = [p.cidr for c in jail.cells for p in c.prisoners if p.active]
    del jail, add, kept
    bans, black = (active, lists["blacklist"]) if white is None else _composed(spark, active, lists["blacklist"], white, folder)
    written = [0]

    def numbered(cidrs: Iterable[str]) -> Iterator[str]:
        for written[0], c in enumerate(cidrs, 1):
            yield c

    write_atomic(config.ban_file, ban_parts(bans, numbered(black), now))
    if written[0]:
        report["warnings"].append({"type": "blacklist_applied", "message": f"{written[0]} entries of the blacklist are in the ban file"})


#: Longer lists are files in the shared folder: rows within a plan are objects in the driver's heap, and the optimizer copies them.
PLAN_ROWS, FILE_ROWS = 10_000, 65_536


def _frame(spark: SparkSession, cidrs: list[str], to: str | None = None) -> DataFrame:
    """The ranges with their place, as (ord, cidr). to: where a long list goes as a file."""
    columns = lambda a, b: pa.table({"ord": pa.array(range(a, b), pa.int64()), "cidr": pa.array(cidrs[a:b], pa.string())})
    if to is None or len(cidrs) <= PLAN_ROWS:
        return spark.createDataFrame(columns(0, len(cidrs)), "ord long, cidr string")
    with tempfile.TemporaryDirectory(prefix="rangewarden-") as folder:
        with pq.ParquetWriter(f"{folder}/list.parquet", columns(0, 0).schema) as w:
            for i in range(0, len(cidrs), FILE_ROWS):
                w.write_table(columns(i, min(i + FILE_ROWS, len(cidrs))))
        return spark.read.schema("ord long, cidr string").parquet(share(spark, f"{folder}/list.parquet", f"{to}/list.parquet"))


def _composed(spark: SparkSession, bans: list[str], blacklist: list[str], white: DataFrame, folder: str) -> tuple[Iterator[str], Iterator[str]]:
    """RNG-6 with both lists in one pass: what the whitelist (start, len) leaves of them, in order, from files in the folder."""
    left = ranges.left_over(_frame(spark, bans + blacklist, f"{folder}/lists"), white)
    rows = left.withColumn("section", (F.col("ord") >= len(bans)).cast("int")).orderBy("section", "ord", "start")
    rows.select("section", "cidr").write.partitionBy("section").option("compression", "none").text(f"{folder}/left")
    return shared_lines(spark, f"{folder}/left/section=0"), shared_lines(spark, f"{folder}/left/section=1")


def compose(spark: SparkSession, bans: list[str], blacklist: list[str], white: DataFrame | list[str] | None) -> tuple[list[str], list[str]]:
    """RNG-6 for lists on the driver; the whitelist may be a table (cidr)."""
    if white is None or isinstance(white, list) and not white:
        return bans, blacklist
    white = _frame(spark, white) if isinstance(white, list) else white

    def left(cidrs: list[str]) -> list[str]:
        got = ranges.remove_whitelisted(_frame(spark, cidrs), white).select("ord", "cidr").toArrow()
        texts = got.column("cidr").to_pylist()
        starts = np.fromiter(((parse_cidr(x) or (0,))[0] for x in texts), np.int64, len(texts))
        return [texts[i] for i in np.lexsort([starts, got.column("ord").to_numpy()])]

    return left(bans), left(blacklist)
