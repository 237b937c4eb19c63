"""CFG-8 to 10: the command line. python -m rangewarden.cli static|live|generate --help"""

from __future__ import annotations

import argparse
import json
import logging
import signal
import sys
import threading

from pyspark.sql import SparkSession

from rangewarden.functions.times import go_duration
from rangewarden.plans.config import Config, ConfigError, check_logging, from_flags, load_config

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}
log = logging.getLogger("rangewarden")


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "msg": record.getMessage()})


def set_up_logging(level: str = "", form: str = "") -> None:
    """SNK-9: leveled lines on standard error, as text or JSON; info and text where nothing is given."""
    check_logging(level, form)
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if form.lower() == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    own = logging.getLogger("rangewarden")
    own.handlers, own.propagate = [handler], False
    own.setLevel(LEVELS[level.lower() or "info"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rangewarden")
    modes = p.add_subparsers(dest="mode", required=True)
    for mode in ("static", "live"):
        m = modes.add_parser(mode)
        m.add_argument("--config")
        for flag in ("--jail-file", "--ban-file", "--whitelist", "--blacklist", "--ua-whitelist", "--ua-blacklist", "--user-agent-regex", "--endpoint-regex"):
            m.add_argument(flag)
        m.add_argument("--cluster-set", action="append", dest="cluster_sets", help="minSize,minDepth,maxDepth,difference")
        m.add_argument("--log-level", help="debug, info, warn or error")
        m.add_argument("--log-form", help="text or json")
        if mode == "static":
            for flag in ("--log-file", "--log-format", "--start", "--end", "--plot-path"):
                m.add_argument(flag)
            m.add_argument("--range", action="append", dest="ranges")
            m.add_argument("--compact", action="store_true")
            m.add_argument("--plain", action="store_true")
            m.add_argument("--view", nargs="?", const="", help="maps and ranges as text, of all tries or of the one that is named")
        else:
            for flag in ("--port", "--stats-listen", "--landing"):
                m.add_argument(flag)
            m.add_argument("--max-age", type=go_duration)
            m.add_argument("--max-size", type=int)
            m.add_argument("--sleep", type=go_duration)
    g = modes.add_parser("generate")
    g.add_argument("folder")
    g.add_argument("--lines", type=int, default=1_000_000)
    g.add_argument("--seed", type=int, default=42)
    return p


def configured(args: argparse.Namespace) -> Config:
    """A configuration file, or flags; a file leaves no other flag but those of output and logging."""
    flags = {k: v for k, v in vars(args).items() if k not in ("mode", "config", "compact", "plain", "view", "log_level", "log_form", "landing") and v is not None}
    if args.config:
        if flags:
            raise ConfigError([f"--config excludes --{k.replace('_', '-')}" for k in flags])
        return load_config(args.config)
    return from_flags(args.mode, **flags)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.mode == "generate":
            set_up_logging()
        else:
            config = configured(args)
            config.validate(args.mode)
            # A flag goes before the file.
            set_up_logging(args.log_level or config.log_level, args.log_form or config.log_form)
            log.info("%s analysis begins", args.mode)
    except (ConfigError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("rangewarden").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.mode == "generate":
        from rangewarden.sources.demo import scaffold

        print("\n".join(scaffold(spark, args.folder, args.lines, args.seed)))
    elif args.mode == "static":
        from rangewarden.plans.report import to_compact_json, to_json, to_plain, to_view
        from rangewarden.plans.static import run_static

        if args.view is not None:
            report = run_static(spark, config, grids=True)
            print(to_view(report, report.get("grids", {}), args.view or None))
            return 0
        print((to_plain if args.plain else to_compact_json if args.compact else to_json)(run_static(spark, config)))
    else:
        run_live(spark, config, args.landing)
    return 0


def run_live(spark: SparkSession, config: Config, landing: str | None) -> None:
    """STR-12: until a signal; then the query stops after its batch."""
    from rangewarden.shipping import shared_dir
    from rangewarden.sources.lumberjack import LumberjackServer, stream_events
    from rangewarden.streaming.live import LiveEngine, serve

    landing = landing or f"{shared_dir(spark)}/landing"
    source = LumberjackServer(landing, port=int(config.port), read_timeout=config.read_timeout.total_seconds())
    engine = LiveEngine(spark, config, f"{shared_dir(spark)}/live")
    engine.attach(source)
    query = engine.start(stream_events(spark, landing), f"{shared_dir(spark)}/live-checkpoint")
    server, beat, done = serve(engine, config.stats_listen) if config.stats_listen else None, engine.beat(), threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: done.set())
    while not done.wait(1) and query.isActive:
        pass
    beat.set()
    query.stop()
    source.close()
    if server:
        server.shutdown()


if __name__ == "__main__":
    sys.exit(main())
