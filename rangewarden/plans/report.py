"""SNK-1, 2, 5, 7: reports as JSON, text, an HTML map of traffic, and metrics."""

from __future__ import annotations

import html
import json
import math


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def to_compact_json(report: dict) -> str:
    return json.dumps(report, separators=(",", ":"), ensure_ascii=False)


def to_plain(report: dict) -> str:
    """The report for a terminal. A set's share is the sum of its merged ranges over what the filter left."""
    g = report["general"]
    out = [f"Log: {g.get('log_file', '-')}", f"Requests: {g.get('total_requests', 0):,}", f"Unique addresses: {g.get('unique_ips', 0):,}"]
    for t in report["tries"]:
        s = t["stats"]
        out += ["", f"== {t['name']} ==", *(f"{k}: {v}" for k, v in t["parameters"].items()), f"After filtering: {s['total_requests_after_filtering']:,} requests, {s['unique_ips']:,} addresses"]
        if s["skipped_invalid_ips"]:
            out.append(f"Invalid addresses: {s['skipped_invalid_ips']:,}")
        out += [f"Range {r['cidr']}: {r['requests']:,} ({r['percentage']:.2f}%)" for r in t["cidr_ranges"]]
        for c in t["clusters"]:
            a, total = c["set"], sum(r["requests"] for r in c["merged_ranges"])
            share = total / s["total_requests_after_filtering"] * 100 if s["total_requests_after_filtering"] else 0.0
            out.append(f"Set {a['min_size']},{a['min_depth']},{a['max_depth']},{a['mean_subnet_difference']:g}: {len(c['merged_ranges'])} ranges, {total:,} requests ({share:.2f}%)")
            out += [f"  {r['cidr']:<18} {r['requests']:>12,} {r['percentage']:>7.2f}%" for r in c["merged_ranges"]]
    for kind in ("warnings", "errors"):
        out += [f"{kind[:-1].title()}: {w['type']}: {w['message']}" for w in report.get(kind, []) if w["type"] != "info"]
    return "\n".join(out) + "\n"


def heatmap_html(cells: list[tuple[int, int, int]], title: str = "Traffic by /16") -> str:
    """A page of its own: a square of 256 by 256 cells, one a /16, shaded by the logarithm of its requests."""
    most = max((n for *_, n in cells), default=1)
    data = json.dumps([[a, b, n, round(math.log1p(n) / math.log1p(most), 3)] for a, b, n in cells])
    return f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>
<canvas id="map" width="1024" height="1024" style="border:1px solid #999"></canvas><p id="at"></p><script>
const cells={data},c=document.getElementById('map'),x=c.getContext('2d'),held={{}};
for(const [a,b,n,s] of cells){{held[a+'.'+b]=n;x.fillStyle=`hsl(${{240-240*s}},80%,50%)`;x.fillRect(b*4,a*4,4,4)}}
c.onmousemove=e=>{{const k=Math.floor(e.offsetY/4)+'.'+Math.floor(e.offsetX/4);document.getElementById('at').textContent=k+'.0.0/16: '+(held[k]||0)}};
</script></body></html>"""


#: Fixed value: characters from no traffic to the most.
SHADES = " .:-=+*#%@"


def grid_text(cells: list[tuple[int, int, int]], scale: int = 8) -> str:
    """SNK-8: the /16 grid as text, blocks of scale by scale cells, first octets down and second ones across, shaded by the logarithm of their requests."""
    sums: dict[tuple[int, int], int] = {}
    for a, b, n in cells:
        sums[a // scale, b // scale] = sums.get((a // scale, b // scale), 0) + n
    most, side = max(sums.values(), default=1), -(-256 // scale)
    shade = lambda n: SHADES[math.ceil(math.log1p(n) / math.log1p(most) * (len(SHADES) - 1))] if n else SHADES[0]
    rows = ["".join(shade(sums.get((i, j), 0)) for j in range(side)) for i in range(side)]
    return "\n".join(["     +" + "-" * side + "+", *(f"{i * scale:4d} |{row}|" for i, row in enumerate(rows)), "     +" + "-" * side + "+"]) + "\n"


def to_view(report: dict, grids: dict[str, list[tuple[int, int, int]]], trie: str | None = None) -> str:
    """SNK-8: a page for each trie, or for one: its grid, counters and ranges as text."""
    out = []
    for t in report["tries"]:
        if trie in (None, t["name"]):
            out.append(f"=== {t['name']} ===\n" + grid_text(grids.get(t["name"], [])) + to_plain(report | {"tries": [t], "warnings": [], "errors": []}))
    return "\n".join(out)


def escape_label(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def metric(name: str, kind: str, text: str, samples: list[tuple[dict, float]]) -> str:
    rows = [f"{name}{'{' + ','.join(f'{k}="{escape_label(str(v))}"' for k, v in labels.items()) + '}' if labels else ''} {value:g}" if isinstance(value, float) else f"{name}{'{' + ','.join(f'{k}="{escape_label(str(v))}"' for k, v in labels.items()) + '}' if labels else ''} {value}" for labels, value in samples]
    return "\n".join([f"# HELP {name} {text}", f"# TYPE {name} {kind}", *rows]) + "\n"


_SOURCE = (
    ("received_batches", "batches_total", "counter", "Batches that the source received."), ("received_events", "events_total", "counter", "Events that the source received."),
    ("source_errors", "errors_total", "counter", "Connections that ended in an error."), ("last_received", "last_batch_timestamp_seconds", "gauge", "Time of the source's last batch."),
    ("queue_depth", "queue_depth", "gauge", "Events received and not processed."),
)


def metrics(snapshot: dict) -> str:
    """A live snapshot in the text format of metric scrapers."""
    p, w, j, i = "rangewarden_", snapshot["windows"], snapshot["jail"], snapshot["ingest"]
    each = lambda key: [({"window": x["name"]}, x[key]) for x in w]
    sets = [({"window": x["name"], "set": str(k)}, s) for x in w for k, s in enumerate(x["sets"])]
    return "".join([
        metric(f"{p}uptime_seconds", "gauge", "Seconds since the start.", [({}, snapshot["uptime_seconds"])]),
        metric(f"{p}iterations_total", "counter", "Batches processed.", [({}, snapshot["iterations"])]),
        metric(f"{p}last_batch_timestamp_seconds", "gauge", "Time of the last batch.", [({}, snapshot["last_batch"])]),
        metric(f"{p}last_iteration_seconds", "gauge", "Seconds the last batch took.", [({}, snapshot["last_seconds"])]),
        metric(f"{p}ingest_batches_total", "counter", "Batches received.", [({}, i["batches"])]),
        metric(f"{p}ingest_requests_total", "counter", "Requests received.", [({}, i["requests"])]),
        metric(f"{p}ingest_parse_errors_total", "counter", "Messages refused.", [({}, i["parse_errors"])]),
        metric(f"{p}ingest_malformed_total", "counter", "Malformed fields.", [({}, i["malformed"])]),
        *(metric(f"{p}source_{name}", kind, text, [({}, i[key])]) for key, name, kind, text in _SOURCE if key in i),
        metric(f"{p}window_requests", "gauge", "Requests in the window.", each("requests")),
        metric(f"{p}window_unique_ips", "gauge", "Addresses in the window.", each("unique_ips")),
        metric(f"{p}window_max_requests", "gauge", "The window's bound.", each("max_size")),
        metric(f"{p}window_accepted_total", "counter", "Requests that passed the window's filter.", each("accepted")),
        metric(f"{p}window_rejected_total", "counter", "Requests that did not.", each("rejected")),
        metric(f"{p}window_detected_ranges", "gauge", "Ranges detected in the last batch.", [(a, s["detected"]) for a, s in sets]),
        metric(f"{p}window_detected_requests", "gauge", "Requests in them.", [(a, s["requests"]) for a, s in sets]),
        metric(f"{p}merged_ranges", "gauge", "Ranges after merging all windows.", [({}, snapshot["merged_ranges"])]),
        metric(f"{p}active_bans", "gauge", "Active bans.", [({}, j["active"])]),
        metric(f"{p}jail_active", "gauge", "Active bans by stage.", [({"stage": s["stage"]}, s["active"]) for s in j["stages"]]),
        metric(f"{p}published_bans", "gauge", "Bans in the ban file.", [({}, snapshot["published"]["bans"])]),
        metric(f"{p}published_blacklist", "gauge", "Blacklist entries in the ban file.", [({}, snapshot["published"]["blacklist"])]),
        metric(f"{p}ua_listed_ips", "gauge", "Addresses of listed user agents.", [({"list": k}, n) for k, n in snapshot["ua_ips"].items()]),
        metric(f"{p}top_talker_requests", "gauge", "Requests of the busiest addresses.", [({"window": x["name"], "ip": t["ip"]}, t["count"]) for x in w for t in x["top_talkers"]]),
    ])
