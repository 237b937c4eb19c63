"""SRC-1 to 12: log files, live messages and list files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import parse_cidr, strict_ip_to_long
from rangewarden.functions.once import once
from rangewarden.functions.times import parse_offset, parse_wall
from rangewarden.sources.logformat import live_method


def read_log(spark: SparkSession, path: str, max_line_length: int | None = None) -> DataFrame:
    """Lines (value) of text files. Files are split for the tasks by where lines start; blank lines stay. A longer line than the limit goes."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines if max_line_length is None else lines.where(F.octet_length("value") < max_line_length)


def stream_log(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of files as they arrive in a folder, as messages."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "message")


def _free(taken: list[str], *names: str) -> list[str]:
    """Names like these that no column has."""
    return [next(x for i in range(len(taken) + 1) if (x := f"_{n}{i}") not in taken) for n in names]


def parse_messages(events: DataFrame, column: str = "message") -> DataFrame:
    """PRJ-12: requests of live messages (combined log lines), with parse_error for what is rejected, null otherwise.

    Address, time and request are required, and strict: no leading zeros, no colon. Status and bytes are
    read if both are there; the third quoted text is the user agent. Other columns stay.
    """
    m = F.col(column)
    quoted = r'"((?:[^"\\]|\\.)*)"'
    keep = events.columns
    ip_text = F.split_part(m, F.lit(" "), F.lit(1))
    time_text = F.regexp_extract(m, r"\[([^\]]*)\]", 1)
    tail_text = F.trim(F.regexp_extract(m, rf"(?s)^[^\"]*{quoted} *([^\"]*)", 2))
    names = _free(keep, "strings", "time", "tail", "ip", "wall")
    events = once(events, *keep, **{names[0]: F.regexp_extract_all(m, F.lit(quoted), F.lit(1)), names[1]: time_text, names[2]: F.split(tail_text, " +")})
    events = once(events, *keep, *names[:3], **{names[3]: strict_ip_to_long(ip_text), names[4]: parse_wall(F.col(names[1]))})
    strings, time, tail, ip, wall = map(F.col, names)
    request = F.get(strings, F.lit(0))
    two = F.size(tail) >= 2
    status, size = F.when(two, F.get(tail, F.lit(0))), F.when(two, F.get(tail, F.lit(1)))
    number = lambda c: F.when(c.rlike(r"^[+-]?\d{1,18}\z"), c.try_cast("long"))
    error: Column = (
        F.when(m.isNull() | (m == ""), "no message").when(~F.contains(m, F.lit(" ")), "no fields").when(F.contains(ip_text, F.lit(":")), "not IPv4").when(ip.isNull(), "bad address")
        .when(~F.contains(m, F.lit("[")), "no time").when(wall.isNull() | (F.length(time) < 26), "bad time").when(request.isNull(), "no request")
    )
    parts = F.split(request, " ")
    return events.select(
        *keep, error.alias("parse_error"), F.coalesce(ip, F.lit(0).cast("long")).alias("ip"), wall.alias("wall_ts"), parse_offset(time).alias("offset_sec"), live_method(F.get(parts, F.lit(0))).alias("method"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("uri"), F.pmod(F.coalesce(number(status), F.lit(0)), F.lit(65536)).cast("int").alias("status"), F.coalesce(F.when(number(size) >= 0, F.pmod(number(size), F.lit(4294967296))), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.get(strings, F.lit(2)), F.lit("")).alias("user_agent"), F.coalesce(two & (status != "-") & number(status).isNull(), F.lit(False)).alias("bad_status"), F.coalesce(two & (size != "-") & number(size).isNull(), F.lit(False)).alias("bad_bytes"),
    )


def list_lines(path: str) -> list[tuple[int, str]]:
    """Numbered entries of a list file: one a line, '#' begins a comment, blank lines don't count."""
    out = []
    for number, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if entry := line.split("#", 1)[0].strip():
            out.append((number, entry))
    return out


def load_patterns(path: str) -> list[str]:
    """SRC-11."""
    return [entry for _, entry in list_lines(path)]


def load_cidrs(path: str) -> list[str]:
    """SRC-10: prefixes of a list file; an entry that isn't one, such as a bare address or IPv6, is an error that names its line."""
    out = []
    for number, entry in list_lines(path):
        if parse_cidr(entry) is None:
            raise ValueError(f"{path}:{number}: {entry!r} is not an IPv4 range")
        out.append(entry)
    return out
