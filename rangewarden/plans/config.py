"""CFG: configurations from TOML or from flags, checked as a whole before anything runs."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

from rangewarden.functions.ipcalc import parse_cidr
from rangewarden.functions.regexes import RegexError, to_java
from rangewarden.functions.times import go_duration, parse_flexible
from rangewarden.operators.clusters import ClusterSet
from rangewarden.operators.jail import load_jail
from rangewarden.sources.logformat import DEFAULT_FORMAT, compile_format
from rangewarden.sources.readers import load_cidrs, load_patterns

#: The set of the flags mode, and the limits of the live mode's flags.
DEFAULT_SET = ClusterSet(1000, 30, 32, 0.2, True)
LIVE_AGE, LIVE_SIZE, LIVE_SLEEP, READ_TIMEOUT = timedelta(hours=2), 100_000, timedelta(seconds=10), timedelta(seconds=5)
_SECTIONS = {"global", "log", "static", "live"}
#: Fixed value: bytes from which on a line is dropped.
MAX_LINE = 2 << 20
_VALUE_BYTES = 120


class ConfigError(ValueError):
    """All that is wrong with a configuration: a heading with the number, then one message a line, sorted and numbered."""

    def __init__(self, found: list[str]):
        self.found = sorted(map(_plain, found))
        super().__init__(f"configuration errors ({len(found)}):\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(self.found, 1)))


def _plain(line: str) -> str:
    """The line with control characters escaped, so that none can forge another line."""
    return "".join(c if c >= " " and c != "\x7f" else {"\n": r"\n", "\r": r"\r", "\t": r"\t"}.get(c, f"\\x{ord(c):02x}") for c in line)


def quoted(value) -> str:
    """A value as given, in quotes: 120 bytes of it at most, whole characters, and an ellipsis where more was cut."""
    text = value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
    raw = text.encode("utf-8", "replace")
    if len(raw) > _VALUE_BYTES:
        text = raw[:_VALUE_BYTES].decode("utf-8", "ignore") + "\u2026"
    return json.dumps(text, ensure_ascii=False)


def invalid(section: str, key: str, value, want: str, cause: object = None) -> str:
    """CFG-2: how a message about one value is worded."""
    return f"[{section}] invalid {key} {quoted(value)}: want {want}" + (f": {cause}" if cause is not None else "")


def check_logging(level: str, form: str) -> None:
    """SNK-9: the words that are known, in any case; nothing is the default."""
    bad = []
    if str(level).lower() not in ("", "debug", "info", "warn", "error"):
        bad.append(invalid("log", "level", level, "debug, info, warn or error"))
    if str(form).lower() not in ("", "text", "json"):
        bad.append(invalid("log", "format", form, "text or json"))
    if bad:
        raise ConfigError(bad)


@dataclass
class Trie:
    """One filter with its cluster sets; for live windows also the bounds of the window."""

    name: str
    user_agent_regex: str | None = None
    endpoint_regex: str | None = None
    start: tuple[datetime, bool] | None = None
    end: tuple[datetime, bool] | None = None
    sets: tuple[ClusterSet, ...] = ()
    ranges: tuple[str, ...] = ()
    max_age: timedelta | None = None
    max_size: int = 0
    sleep: timedelta = LIVE_SLEEP

    @property
    def filtered(self) -> bool:
        return bool(self.user_agent_regex or self.endpoint_regex or self.start or self.end)


@dataclass
class Config:
    jail_file: str | None = None
    ban_file: str | None = None
    whitelist: str | None = None
    blacklist: str | None = None
    ua_whitelist: str | None = None
    ua_blacklist: str | None = None
    log_file: str | None = None
    log_format: str = DEFAULT_FORMAT
    plot_path: str | None = None
    tries: list[Trie] = field(default_factory=list)
    windows: list[Trie] = field(default_factory=list)
    port: str | None = None
    stats_listen: str | None = None
    top_talkers: int = 10
    log_level: str = ""
    log_form: str = ""
    max_line_length: int | None = MAX_LINE
    read_timeout: timedelta = READ_TIMEOUT
    errors: list[str] = field(default_factory=list)

    def lists(self) -> dict[str, list[str]]:
        """The entries of all list files."""
        return {
            "whitelist": load_cidrs(self.whitelist) if self.whitelist else [], "blacklist": load_cidrs(self.blacklist) if self.blacklist else [],
            "ua_whitelist": load_patterns(self.ua_whitelist) if self.ua_whitelist else [], "ua_blacklist": load_patterns(self.ua_blacklist) if self.ua_blacklist else [],
        }

    def validate(self, mode: str) -> None:
        """CFG-1: everything is checked; whatever is wrong is reported at once, as a ConfigError."""
        bad = list(self.errors)

        def attempt(section: str, key: str, value, want: str, fn, *args) -> None:
            try:
                fn(*args)
            except (ValueError, OSError, KeyError, TypeError, AttributeError) as e:
                bad.append(invalid(section, key, value, want, e))

        for key, path in (("whitelist", self.whitelist), ("blacklist", self.blacklist)):
            if path:
                attempt("global", key, path, "a file of IPv4 ranges", load_cidrs, path)
        for key, path in (("userAgentWhitelist", self.ua_whitelist), ("userAgentBlacklist", self.ua_blacklist)):
            if path:
                attempt("global", key, path, "a readable file", load_patterns, path)
        if self.jail_file:
            attempt("global", "jailFile", self.jail_file, "a jail or no file yet", load_jail, self.jail_file)
        try:
            check_logging(self.log_level, self.log_form)
        except ConfigError as e:
            bad += e.found
        if mode == "static":
            attempt("static", "logFormat", self.log_format, "a format with %h", compile_format, self.log_format)
            if not self.log_file:
                bad.append(invalid("static", "logFile", "", "the path of a log"))
            elif "://" not in self.log_file and not Path(self.log_file).exists():
                bad.append(invalid("static", "logFile", self.log_file, "the path of a log", "it does not exist"))
            if self.max_line_length is not None and self.max_line_length <= 0:
                bad.append(invalid("static", "maxLineLength", self.max_line_length, "a positive number"))
            if not self.tries:
                bad.append("[static] no trie: want one section static.<name> at least")
        else:
            for section, key, value in (("live", "port", self.port), ("global", "jailFile", self.jail_file), ("global", "banFile", self.ban_file)):
                if not value:
                    bad.append(invalid(section, key, "", "a value in live mode"))
            if self.port and not (str(self.port).isdigit() and 0 < int(self.port) < 65536):
                bad.append(invalid("live", "port", self.port, "1 to 65535"))
            if self.top_talkers < 0:
                bad.append(invalid("live", "topTalkers", self.top_talkers, "0 or more"))
            if self.stats_listen and not (":" in self.stats_listen and self.stats_listen.rpartition(":")[2].isdigit()):
                bad.append(invalid("live", "statsListen", self.stats_listen, "host:port"))
            if not self.windows:
                bad.append("[live] no window: want one section live.<name> at least")
        for section, t in [*(("static", t) for t in self.tries if mode == "static"), *(("live", t) for t in self.windows if mode == "live")]:
            at = f"{section}.{t.name}"
            for key, pattern in (("useragentRegex", t.user_agent_regex), ("endpointRegex", t.endpoint_regex)):
                if pattern:
                    attempt(at, key, pattern, "a regular expression", to_java, pattern)
            if t.start and t.end and t.start[1] == t.end[1] and t.end[0] < t.start[0]:
                bad.append(f"[{at}] endTime {quoted(t.end[0].isoformat())} is before startTime {quoted(t.start[0].isoformat())}: want endTime >= startTime")
            bad += [invalid(at, f"cidrRanges[{i}]", r, "an IPv4 range") for i, r in enumerate(t.ranges) if parse_cidr(str(r)) is None]
            for i, s in enumerate(t.sets):
                if not 0 <= s.min_depth <= s.max_depth <= 32:
                    bad.append(invalid(at, f"clusterArgSets[{i}]", [s.min_depth, s.max_depth], "depths with 0 <= minDepth <= maxDepth <= 32"))
                if s.min_size < 0:
                    bad.append(invalid(at, f"clusterArgSets[{i}]", s.min_size, "a minClusterSize of 0 or more"))
            if section == "live":
                if t.max_size <= 0:
                    bad.append(invalid(at, "slidingWindowMaxSize", t.max_size, "a positive number"))
                if not t.max_age or t.max_age <= timedelta():
                    bad.append(invalid(at, "slidingWindowMaxTime", t.max_age or 0, "a positive duration"))
                if not t.sets:
                    bad.append(invalid(at, "clusterArgSets", "", "one cluster set at least"))
        if bad:
            raise ConfigError(bad)


def _typed(section: str, raw, kinds: dict) -> dict:
    """CFG-3: raw, a table whose known keys have values of these kinds; anything else fails at once."""
    if not isinstance(raw, dict):
        raise ConfigError([invalid(section, "section", raw, "a table")])
    bad = []
    for key, value in raw.items():
        kind, name = kinds.get(key, (object, ""))
        if not isinstance(value, kind) or isinstance(value, bool) and kind in (int, (int, float)):
            bad.append(invalid(section, key, value, name))
    if bad:
        raise ConfigError(bad)
    return raw


#: Kinds of values and their names.
_TEXT, _NUMBER, _LIST = (str, "a string"), (int, "a whole number"), (list, "a list")
_KINDS = {
    "global": dict.fromkeys(("jailFile", "banFile", "whitelist", "blacklist", "userAgentWhitelist", "userAgentBlacklist"), _TEXT),
    "log": dict.fromkeys(("level", "format"), _TEXT),
    "static": dict.fromkeys(("logFile", "logFormat", "plotPath"), _TEXT) | {"maxLineLength": _NUMBER},
    "live": dict.fromkeys(("statsListen", "readTimeout"), _TEXT) | {"topTalkers": _NUMBER, "port": ((str, int), "a port")},
    "trie": dict.fromkeys(("useragentRegex", "endpointRegex", "slidingWindowMaxTime", "sleepBetweenIterations"), _TEXT)
    | dict.fromkeys(("cidrRanges", "clusterArgSets", "useForJail"), _LIST) | {"slidingWindowMaxSize": _NUMBER, "startTime": ((str, datetime), "a time"), "endTime": ((str, datetime), "a time")},
}


def _duration(section: str, key: str, value: str) -> timedelta:
    try:
        return go_duration(value)
    except ValueError as e:
        raise ConfigError([invalid(section, key, value, "a duration such as 1h30m", e)]) from None


def _unknown(section: str, key: str, known) -> str:
    return f"[{section}] unknown key {quoted(key)} (want: {', '.join(sorted(known))})"


def _trie(section: str, name: str, raw: dict, errors: list[str]) -> Trie:
    at, live = f"{section}.{name}", section == "live"
    known = {"useragentRegex", "endpointRegex", "clusterArgSets", "useForJail"} | ({"slidingWindowMaxTime", "slidingWindowMaxSize", "sleepBetweenIterations"} if live else {"startTime", "endTime", "cidrRanges"})
    errors += [_unknown(at, k, known) for k in raw if k not in known]
    raw = _typed(at, {k: v for k, v in raw.items() if k in known}, _KINDS["trie"])
    t = Trie(name, raw.get("useragentRegex") or None, raw.get("endpointRegex") or None, ranges=tuple(raw.get("cidrRanges", ())))
    rows, jail = raw.get("clusterArgSets", []), raw.get("useForJail")
    if jail is not None and not all(isinstance(x, bool) for x in jail):
        raise ConfigError([invalid(at, "useForJail", jail, "a list of true and false")])
    if jail is not None and len(jail) != len(rows):
        errors.append(f"[{at}] useForJail has {len(jail)} entries for {len(rows)} rows of clusterArgSets: want one for each")
    sets = []
    for i, row in enumerate(rows):
        if not isinstance(row, list) or len(row) != 4 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in row):
            errors.append(f"[{at}] clusterArgSets row {i} {quoted(row)}: want [minClusterSize, minDepth, maxDepth, meanSubnetDifference]")
            continue
        sets.append(ClusterSet(int(row[0]), int(row[1]), int(row[2]), float(row[3]), bool(jail[i]) if jail and i < len(jail) else False))
    t.sets = tuple(sets)
    for key, to in (("startTime", "start"), ("endTime", "end")):
        if key in raw:
            try:
                at_time = raw[key] if isinstance(raw[key], datetime) else datetime.fromisoformat(raw[key])
                if at_time.tzinfo is None:
                    raise ValueError("it has no offset")
                setattr(t, to, (at_time, True))
            except ValueError as e:
                errors.append(invalid(at, key, raw[key], "a time with an offset", e))
    if live:
        t.max_age, t.max_size = _duration(at, "slidingWindowMaxTime", raw.get("slidingWindowMaxTime", "0")), raw.get("slidingWindowMaxSize", 0)
        t.sleep = _duration(at, "sleepBetweenIterations", raw["sleepBetweenIterations"]) if "sleepBetweenIterations" in raw else LIVE_SLEEP
    return t


def from_toml(text: str) -> Config:
    """CFG-3: a text that isn't TOML, has an unknown section, a wrong type or a malformed duration fails at once; the rest is kept for validate()."""
    raw = tomllib.loads(text)
    if unknown := set(raw) - _SECTIONS:
        raise ConfigError([f"unknown section {quoted(x)} (want: {', '.join(sorted(_SECTIONS))})" for x in unknown])
    c = Config()
    parts = {name: _typed(name, raw.get(name, {}), _KINDS[name]) for name in sorted(_SECTIONS)}
    to = {
        "global": {"jailFile": "jail_file", "banFile": "ban_file", "whitelist": "whitelist", "blacklist": "blacklist", "userAgentWhitelist": "ua_whitelist", "userAgentBlacklist": "ua_blacklist"},
        "log": {"level": "log_level", "format": "log_form"}, "static": {"logFile": "log_file", "logFormat": "log_format", "plotPath": "plot_path", "maxLineLength": "max_line_length"},
        "live": {"port": "port", "statsListen": "stats_listen", "topTalkers": "top_talkers", "readTimeout": None},
    }
    for section, found in parts.items():
        for key, value in found.items():
            if isinstance(value, dict) and section in ("static", "live"):
                (c.tries if section == "static" else c.windows).append(_trie(section, key, value, c.errors))
            elif key not in to[section]:
                c.errors.append(_unknown(section, key, to[section]))
            elif key == "readTimeout":
                c.read_timeout = _duration(section, key, value)
            elif value or section != "global":
                setattr(c, to[section][key], str(value) if key == "port" else value)
    return c


def load_config(path: str) -> Config:
    return from_toml(Path(path).read_text(encoding="utf-8"))


def from_flags(mode: str, **flags) -> Config:
    """CFG-8, 9: one trie or window from flags; all its sets count for the jail."""
    c = Config(**{k: flags[k] for k in ("jail_file", "ban_file", "whitelist", "blacklist", "ua_whitelist", "ua_blacklist", "log_file", "plot_path", "port", "stats_listen") if flags.get(k)})
    c.log_format = flags.get("log_format") or DEFAULT_FORMAT
    t = Trie("cli_trie" if mode == "static" else "cli_default", flags.get("user_agent_regex"), flags.get("endpoint_regex"), ranges=tuple(flags.get("ranges") or ()))
    for key in ("start", "end"):
        if flags.get(key):
            try:
                setattr(t, key, parse_flexible(flags[key]))
            except ValueError as e:
                c.errors.append(invalid(t.name, key, flags[key], "a time", e))
    sets = []
    for text in flags.get("cluster_sets") or ():
        try:
            size, lo, hi, difference = text.split(",")
            sets.append(ClusterSet(int(size), int(lo), int(hi), float(difference), True))
        except ValueError:
            c.errors.append(invalid(t.name, "cluster set", text, "minSize,minDepth,maxDepth,difference"))
    t.sets = tuple(sets) or (DEFAULT_SET,)
    if mode == "live":
        t.max_age, t.max_size, t.sleep = flags.get("max_age") or LIVE_AGE, flags.get("max_size") or LIVE_SIZE, flags.get("sleep") or LIVE_SLEEP
        c.windows.append(t)
    else:
        c.tries.append(t)
    return c
