"""STR: continuous analysis. Micro-batches feed windows whose survivors are tables; one jail takes what all windows find."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import cidr_text, format_cidr, format_ip
from rangewarden.operators import clusters, filters, prefixes, ranges, windows
from rangewarden.operators.jail import Jail, ban_file, load_jail, save_jail, write_atomic
from rangewarden.plans.config import Config, Trie
from rangewarden.plans.report import metrics
from rangewarden.plans.static import compose, merge
from rangewarden.sources.readers import parse_messages

#: What a snapshot lists at most, and how often it looks for top talkers.
MAX_BANS, MAX_LIST, TALKERS_EVERY = 500, 1000, 5


@dataclass
class State:
    """What a batch leaves to the next: tables of survivors and of listed addresses, and counters."""

    batch: int | None = None
    iterations: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    seen: str | None = None
    counters: dict[str, int] = field(default_factory=lambda: {"batches": 0, "requests": 0, "parse_errors": 0, "malformed": 0})
    passed: dict[str, list[int]] = field(default_factory=dict)
    talkers: dict[str, list[dict]] = field(default_factory=dict)

    def paths(self) -> set[str]:
        return {*self.tables.values(), *([self.seen] if self.seen else [])}


class LiveEngine:
    """Windows of survivors, addresses of listed agents, counters and the jail, kept from batch to batch.

    process() runs for each batch, in foreachBatch or by hand; the clock is given. All tables lie in the state folder, and
    each batch ends with a record there of what it left and what it began with. So an engine that starts anew goes on where
    the last one ended, and a batch that is run again starts from the same state. Jailing a range that is jailed already
    changes nothing, so that holds for the jail too. Tables that no record needs are deleted.
    """

    def __init__(self, spark: SparkSession, config: Config, state_dir: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        config.validate("live")
        self.spark, self.config, self.dir, self.clock = spark, config, state_dir.rstrip("/"), clock
        self.lists = config.lists()
        self.agents = filters.user_agent_list(spark, self.lists["ua_whitelist"], self.lists["ua_blacklist"])
        self.jail: Jail = load_jail(config.jail_file)
        self.state, self.before = self._load()
        self.source = None
        self.listed = {1: 0, -1: 0}
        self.began, self.last = time.time(), ()
        self.lock = threading.Lock()
        self.published: tuple[list[str], list[str]] | None = None
        self.snapshot: dict | None = None

    @property
    def counters(self) -> dict[str, int]:
        return self.state.counters

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _load(self) -> tuple[State, State]:
        """The last batch's state and the one before it, from the newest record that was finished."""
        fs, p = self._files(f"{self.dir}/records")
        if not fs.exists(p):
            return State(), State()
        done = [int(f.getPath().getName()) for f in fs.listStatus(p) if self._done(f.getPath().toString())]
        if not done:
            return State(), State()
        kept = json.loads(self.spark.read.text(f"{self.dir}/records/{max(done)}").first()[0])
        return State(**kept["now"]), State(**kept["before"])

    def _done(self, path: str) -> bool:
        fs, p = self._files(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _save(self, now: State, before: State) -> None:
        record = json.dumps({"now": asdict(now), "before": asdict(before)})
        number = now.iterations
        self.spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.dir}/records/{number}")
        # A batch that was run again has the number of its first run.
        old = (self.state.paths() | self.before.paths()) - now.paths() - before.paths()
        self.state, self.before = now, before
        for path in [*old, f"{self.dir}/records/{number - 2}"]:
            fs, p = self._files(path)
            fs.delete(p, True)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        with self.lock:
            self._process(batch, batch_id)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        began, now = time.time(), self.clock()
        before = self.before if self.state.batch == batch_id else self.state
        state = State(batch_id, before.iterations + 1, talkers=before.talkers, passed={k: [*v] for k, v in before.passed.items()})
        arrival = (F.lit(state.iterations).cast("long") * (1 << 40) + F.monotonically_increasing_id()).alias("arrival")
        parsed = filters.with_verdict(parse_messages(batch.select("message", arrival)), self.agents).persist()
        try:
            c = parsed.agg(F.count("*").alias("n"), F.count_if(F.col("parse_error").isNotNull()).alias("e"), F.coalesce(F.sum(F.col("bad_status").cast("int") + F.col("bad_bytes").cast("int")), F.lit(0)).alias("m")).first()
            old = before.counters
            state.counters = {"batches": old["batches"] + 1, "requests": old["requests"] + c["n"] - c["e"], "parse_errors": old["parse_errors"] + c["e"], "malformed": old["malformed"] + c["m"]}
            good = parsed.where("parse_error IS NULL AND ip <> 0 AND wall_ts IS NOT NULL")
            # Agents are told apart before any window's filter; whoever was listed is remembered by when it was processed.
            fresh = good.where("verdict IN (1, -1)").select("verdict", "ip", F.lit(now).cast("timestamp").alias("at"))
            state.seen = self._path("seen", state)
            self._listed(before, now).unionByName(fresh).groupBy("verdict", "ip").agg(F.max("at").alias("at")).write.mode("overwrite").parquet(state.seen)
            rows = good.where("NOT (verdict <=> 1)").withColumn("ts", F.timestamp_add("SECOND", -F.col("offset_sec"), F.col("wall_ts")))
            found, shown, all_ = [], [], rows.count()
            for w in self.config.windows:
                ranges_, view = self._window(w, rows, all_, before, state, now)
                found += ranges_
                shown.append(view)
            merged = merge(found)
            self._punish(merged, state, now)
        finally:
            parsed.unpersist()
        self._save(state, before)
        self.last = (shown, len(merged), began, time.time() - began)
        self._show(now)

    def _path(self, name: str, state: State) -> str:
        return f"{self.dir}/{name}/{state.iterations}-{uuid.uuid4().hex[:8]}"

    def _window(self, w: Trie, rows: DataFrame, all_: int, before: State, state: State, now: datetime) -> tuple[list[tuple[int, int]], dict]:
        keep = filters.request_filter(w.user_agent_regex, w.endpoint_regex)
        mine = (rows if keep is None else rows.where(keep)).select("ts", "arrival", "ip")
        n = mine.count()
        accepted, rejected = before.passed.get(w.name, (0, 0))
        state.passed[w.name] = [accepted + n, rejected + all_ - n]
        old = before.tables.get(w.name)
        fresh = mine if not old else self._rows(old).union(mine)
        cutoff = F.lit((now.astimezone(timezone.utc) - w.max_age).replace(tzinfo=None)).cast("timestamp_ntz")
        state.tables[w.name] = path = self._path(f"window-{w.name}", state)
        windows.survivors(fresh, cutoff, w.max_size).write.mode("overwrite").parquet(path)
        now_rows = self._rows(path)
        counts = prefixes.address_counts(now_rows)
        got = clusters.detect(counts, list(w.sets)).collect()
        total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"), F.count("*").alias("u")).first()
        if state.iterations == 1 or state.iterations % TALKERS_EVERY == 0:
            state.talkers = state.talkers | {w.name: [{"ip": format_ip(r["ip"]), "count": r["cnt"], "last": r["last"].isoformat()} for r in windows.address_stats(now_rows).orderBy(F.desc("cnt"), "ip").limit(max(0, self.config.top_talkers)).collect()]}
        view = {"name": w.name, "requests": total["n"], "unique_ips": total["u"], "max_size": w.max_size, "accepted": state.passed[w.name][0], "rejected": state.passed[w.name][1], "top_talkers": state.talkers.get(w.name, []), "sets": [{"detected": sum(r["set_id"] == i for r in got), "requests": sum(r["cnt"] for r in got if r["set_id"] == i)} for i in range(len(w.sets))]}
        return [(r["start"], r["len"]) for r in got if w.sets[r["set_id"]].use_for_jail], view

    def _rows(self, path: str) -> DataFrame:
        return self.spark.read.schema("ts timestamp_ntz, arrival long, ip long").parquet(path)

    def window_rows(self, name: str) -> DataFrame:
        """The requests (ts, arrival, ip) that a window holds after the last batch."""
        return self._rows(self.state.tables[name])

    def _listed(self, state: State, now: datetime) -> DataFrame:
        """Addresses of listed agents (verdict, ip, at) that were seen within the longest window."""
        schema = "verdict int, ip long, at timestamp"
        seen = self.spark.read.schema(schema).parquet(state.seen) if state.seen else self.spark.createDataFrame([], schema)
        return seen.where(F.col("at") >= F.lit(now - max(w.max_age for w in self.config.windows)).cast("timestamp"))

    def listed_addresses(self, verdict: int) -> DataFrame:
        """Addresses (ip, at) of agents on the whitelist (1) or the blacklist (-1) that count now."""
        return self._listed(self.state, self.clock()).where(F.col("verdict") == verdict).select("ip", "at")

    def _white(self, state: State, now: datetime) -> DataFrame:
        """The whitelist and the addresses of whitelisted agents, as a table: there may be many."""
        fixed = self.spark.createDataFrame([(x,) for x in self.lists["whitelist"]], "cidr string")
        return fixed.union(self._listed(state, now).where("verdict = 1").select(cidr_text(F.col("ip"), F.lit(32))))

    def _punish(self, merged: list[tuple[int, int]], state: State, now: datetime) -> None:
        """One merge over all windows, what is whitelisted goes, listed agents go to jail; then jail and ban file are written."""
        add = [format_cidr(*r) for r in merged]
        if add:
            frame = self.spark.createDataFrame(list(enumerate(add)), "ord long, cidr string")
            add = [r["cidr"] for r in ranges.drop_fully_whitelisted(frame, self._white(state, now)).orderBy("ord").collect()]
        black = [format_cidr(r["ip"], 32) for r in self._listed(state, now).where("verdict = -1").select("ip").orderBy("ip").collect()]
        self.jail.update(add + black, now)
        self.jail.prune(now)
        save_jail(self.jail, self.config.jail_file)
        self._publish(state, now, always=True)

    def _publish(self, state: State, now: datetime, always: bool = False) -> bool:
        self.listed = {1: 0, -1: 0} | {r["verdict"]: r["count"] for r in self._listed(state, now).groupBy("verdict").count().collect()}
        white = self._white(state, now) if self.lists["whitelist"] or self.listed[1] else None
        lists = compose(self.spark, [x["cidr"] for x in self.jail.active()], self.lists["blacklist"], white)
        if not always and lists == self.published:
            return False
        write_atomic(self.config.ban_file, ban_file(*lists, now))
        self.published = lists
        return True

    def heartbeat(self) -> bool:
        """STR-9, without data: bans end, and the ban file is written if that changes it."""
        with self.lock:
            now = self.clock()
            self.jail.expire(now)
            if self.jail.prune(now):
                save_jail(self.jail, self.config.jail_file)
            changed = self._publish(self.state, now)
            if self.last:
                self._show(now)
            return changed

    def _ingest(self) -> dict:
        """SRC-9: the counters of what was processed, and of the source where there is one: what it received and what still waits."""
        out: dict = {**self.counters}
        if self.source is not None:
            s, processed = self.source.stats, self.counters["requests"] + self.counters["parse_errors"] - self.processed_before
            out |= {"received_batches": s.batches, "received_events": s.events, "source_errors": s.errors, "last_received": s.last_batch, "queue_depth": max(0, s.events - processed)}
        return out

    def attach(self, source) -> None:
        """A source whose stats (batches, events, errors, last_batch) count from now on."""
        self.source, self.processed_before = source, self.counters["requests"] + self.counters["parse_errors"]

    def _show(self, now: datetime) -> None:
        """STR-11: an immutable snapshot takes the place of the last one."""
        shown, merged, began, took = self.last
        active = self.jail.active()
        stages = [{"stage": c.id, "active": sum(p.active for p in c.prisoners), "prisoners": len(c.prisoners)} for c in self.jail.cells]
        bans, black = self.published or ([], [])
        self.snapshot = {
            "generated_at": now.isoformat(), "uptime_seconds": round(time.time() - self.began, 3), "iterations": self.state.iterations, "last_batch": round(began, 3), "last_seconds": round(took, 3), "ingest": self._ingest(), "windows": shown, "merged_ranges": merged,
            "jail": {"active": len(active), "stages": stages, "bans": [x | {"ban_start": x["ban_start"].isoformat(), "expires": x["expires"].isoformat()} for x in active[:MAX_BANS]], "truncated": len(active) > MAX_BANS},
            "published": {"bans": len(bans), "blacklist": len(black)}, "lists": {k: {"count": len(v), "cidrs": v[:MAX_LIST]} for k, v in (("whitelist", self.lists["whitelist"]), ("blacklist", self.lists["blacklist"]))},
            "ua_ips": {"whitelist": self.listed[1], "blacklist": self.listed[-1]}, "ban_list": bans + black,
        }

    def start(self, messages: DataFrame, checkpoint: str, available_now: bool = False):
        """Runs over a stream with a message column. The longest sleep of the windows is the time between batches."""
        sleep = max(w.sleep for w in self.config.windows)
        writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.process)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{max(1, int(sleep.total_seconds()))} seconds")).start()

    def beat(self, every: float = 1.0) -> threading.Event:
        """Heartbeats in a thread until the event is set."""
        stop = threading.Event()

        def loop() -> None:
            while not stop.wait(every):
                self.heartbeat()

        threading.Thread(target=loop, daemon=True).start()
        return stop


def serve(engine: LiveEngine, listen: str) -> ThreadingHTTPServer:
    """SNK-6: /stats, /bans and /metrics of the last snapshot; 503 before there is one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            shown = engine.snapshot
            kinds = {"/stats": ("application/json", lambda s: json.dumps({k: v for k, v in s.items() if k != "ban_list"}, default=str)), "/bans": ("text/plain; charset=utf-8", lambda s: "".join(f"{c}\n" for c in s["ban_list"])), "/metrics": ("text/plain; version=0.0.4", metrics)}
            if self.path not in kinds:
                self.send_error(404)
                return
            kind, render = kinds[self.path]
            body = render(shown).encode() if shown else b"no data yet\n"
            self.send_response(200 if shown else 503)
            if not shown:
                self.send_header("Retry-After", "5")
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    host, _, port = listen.rpartition(":")
    server = ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
