"""PRJ-7, 17, 18: times of log lines. A time is a wall clock and the seconds of its zone's offset."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing time in comparisons.
MISSING = "timestamp_ntz'0001-01-01 00:00:00'"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"


def parse_wall(field: Column) -> Column:
    """dd/Mon/yyyy:HH:MM:SS as a wall clock; null if it is shorter than 20 characters or the month is unknown.

    Days, hours, minutes and seconds over their range carry over, as day 32 does into the next month.
    Digits are required; other characters give null.
    """
    part = lambda at, n: F.substring(field, at, n).try_cast("int")
    place = F.instr(F.lit(MONTHS), F.substring(field, 4, 3))
    month = F.when(place % 4 == 1, ((place + 3) / 4).cast("int"))
    first = F.call_function("make_date", part(8, 4), month, F.lit(1)).cast("timestamp_ntz")
    seconds = (part(1, 2) - 1) * 86400 + part(13, 2) * 3600 + part(16, 2) * 60 + part(19, 2)
    ok = (F.length(field) >= 20) & field.rlike(r"^\d\d.{4,}\d\d") & (part(8, 4) > 0)
    return F.when(ok, F.timestamp_add("SECOND", seconds, first))


def parse_offset(field: Column) -> Column:
    """Seconds east of UTC from characters 22 to 26; 0 if they are missing or malformed."""
    zone = F.substring(field, 22, 5)
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    value = sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60)
    return F.when((F.length(field) >= 26) & zone.rlike(r"^[+-]\d{4}\z"), value).otherwise(F.lit(0))


def within(start: tuple[datetime, bool] | None, end: tuple[datetime, bool] | None) -> Column | None:
    """FLT-1: wall_ts and offset_sec inside bounds that both belong to it; None without bounds.

    A bound with an offset (True) compares instants; one without compares wall clocks, whatever the row's zone.
    """
    wall = F.coalesce(F.col("wall_ts"), F.expr(MISSING))
    instant = F.timestamp_add("SECOND", -F.coalesce(F.col("offset_sec"), F.lit(0)), wall)
    out = None
    for bound, low in ((start, True), (end, False)):
        if bound:
            at, aware = bound
            at = at.astimezone(timezone.utc) if aware else at
            literal, value = F.expr(f"timestamp_ntz'{at.strftime('%Y-%m-%d %H:%M:%S.%f')}'"), instant if aware else wall
            one = value >= literal if low else value <= literal
            out = one if out is None else out & one
    return out


def parse_flexible(text: str) -> tuple[datetime, bool]:
    """PRJ-18: a time of the command line and whether it has an offset: date and time to the second or minute, or a date alone."""
    text = text.strip()
    for layout in ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M%z", "%Y-%m-%d %H:%M:%S %z"):
        try:
            return datetime.strptime(text, layout), True
        except ValueError:
            pass
    for layout in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, layout), False
        except ValueError:
            pass
    raise ValueError(f"cannot read the time {text!r}")


def go_duration(text: str) -> timedelta:
    """A duration such as 1h30m, 250ms or 2d."""
    import re

    if text == "0":
        return timedelta()
    units = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    sign = -1 if text[:1] == "-" else 1
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise ValueError(f"invalid duration {text!r}")
    return sign * timedelta(seconds=sum(float(a) * units[b] for a, b in parts))
