"""PRJ-1 to 11: format strings, compiled to one regular expression that a scan evaluates once a line."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import ip_to_long, octets
from rangewarden.functions.once import once
from rangewarden.functions.times import parse_offset, parse_wall

#: The codes of fields, the default format, and methods.
CODES = "htrmsbUu^"
DEFAULT_FORMAT = '%^ %^ %^ [%t] "%r" %s %b %^ "%u" "%h"'
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")
#: Stands between fields after the match; a line that holds it has no fields.
_SEP = "\x01"


@dataclass(frozen=True)
class Field:
    code: str
    kind: str  # bare, quoted, bracket, both
    delimiter: str


def compile_format(text: str) -> list[Field]:
    """PRJ-1, 2. Each field ends at the character that follows its code (a blank by default); other characters of the format don't matter."""
    if not text:
        raise ValueError("log format is empty")
    out, seen, i = [], set(), 0
    while i < len(text):
        if text[i] != "%":
            i += 1
            continue
        code = text[i + 1 : i + 2]
        if not code:
            raise ValueError("log format ends with a lone %")
        if code not in CODES:
            raise ValueError(f"unknown format code %{code}")
        if code != "^" and code in seen:
            raise ValueError(f"duplicate format code %{code}")
        seen.add(code)
        nxt = text[i + 2 : i + 3]
        quoted, bracket = code == "u" or nxt == '"', code == "t"
        out.append(Field(code, "both" if quoted and bracket else "quoted" if quoted else "bracket" if bracket else "bare", nxt or " "))
        i += 2
    if "h" not in seen:
        raise ValueError("log format needs %h")
    return out


def _fragment(f: Field) -> tuple[str, int]:
    """A field's pattern and the number of its groups; it can always match, if only the empty string."""
    d = re.escape(f.delimiter)
    quoted = r'"([^"\\]*+(?:\\.[^"\\]*+)*+\\?+)"?+'
    bracket = r"\[([^\]]*+)\]?+"
    cls = f"[^{re.escape(f.delimiter) if f.delimiter != ' ' else ''} ]*+"
    if f.kind == "bare":
        return f" *+({cls})(?:{d})?+", 1
    if f.kind == "quoted":
        return f' *+(?:{quoted}|(?!")({cls})(?:"|{d})?+)', 2
    if f.kind == "bracket":
        return rf" *+(?:{bracket}|(?!\[)({cls})(?:\]|{d})?+)", 2
    return rf' *+(?:{quoted}|{bracket}|(?!["\[])({cls})(?:"|\]|{d})?+)', 3


def line_fields(line: Column, fields: list[Field], only: set[str] | None = None) -> tuple[Column, dict[str, int]]:
    """The fields of a line as one array of texts, and the place of each code in it. only: those that are wanted; the pattern ends after the last of them."""
    wanted = [i for i, f in enumerate(fields) if f.code != "^" and (only is None or f.code in only)]
    pattern, groups, at = "(?s)^", 0, {}
    for i, f in enumerate(fields[: wanted[-1] + 1]):
        fragment, n = _fragment(f)
        pattern += fragment
        at[i] = range(groups + 1, groups + n + 1)
        groups += n
    # Alternatives of one field stand side by side: the ones that didn't take part are empty.
    target = _SEP.join("".join(f"${g}" for g in at[i]) for i in wanted)
    line = F.when(F.endswith(line, F.lit("\r")), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    parts = F.split(F.when(F.contains(line, F.lit(_SEP)), F.lit("")).otherwise(F.regexp_replace(line, pattern + r".*\z", target)), _SEP)
    return parts, {fields[i].code: k for k, i in enumerate(wanted)}


def _field(at: dict[str, int], code: str) -> Column:
    return F.coalesce(F.get(F.col("_f"), F.lit(at[code])), F.lit("")) if code in at else F.lit("")


def _parsed(lines: DataFrame, log_format: str, column: str, only: set[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """A row a line: its fields (_f) and its address (ip), each evaluated once."""
    parts, at = line_fields(F.col(column), compile_format(log_format), only)
    host = _field(at, "h")
    split = once(once(lines, _f=parts), "_f", _o=octets(host))
    return once(split, "_f", ip=ip_to_long(host, F.col("_o"))), at


def static_method(text: Column) -> Column:
    """PRJ-8: by the first letters. A missing method reads as GET."""
    return F.when(text == "", "GET").when(F.startswith(text, F.lit("G")), "GET").when(F.startswith(text, F.lit("PO")), "POST").when(F.startswith(text, F.lit("PA")), "PATCH").when(F.startswith(text, F.lit("P")), "PUT").when(F.startswith(text, F.lit("D")), "DELETE").when(F.startswith(text, F.lit("H")), "HEAD").when(F.startswith(text, F.lit("O")), "OPTIONS").otherwise("UNKNOWN")


def live_method(text: Column) -> Column:
    """PRJ-9: the exact word."""
    return F.when(text.isin(*METHODS), text).otherwise("UNKNOWN")


def status_of(text: Column) -> tuple[Column, Column]:
    """PRJ-11: three digits; '-' and nothing are 0. The second column tells malformed ones."""
    ok = text.rlike(r"^\d{3}\z")
    return F.when(ok, text.try_cast("int")).otherwise(F.lit(0)), ~ok & (text != "") & (text != "-")


def bytes_of(text: Column) -> tuple[Column, Column]:
    """PRJ-11: digits, modulo 2^32; what begins with '-' is 0."""
    ok = text.rlike(r"^\d+\z")
    digits = F.when(ok, F.regexp_replace(text, "^0+(?=.)", ""))
    value = F.pmod(digits.try_cast("decimal(38,0)"), F.lit(4294967296).cast("decimal(38,0)")).cast("long")
    return F.coalesce(value, F.lit(0).cast("long")), ~ok & (text != "") & ~F.startswith(text, F.lit("-"))


def parse_lines(lines: DataFrame, log_format: str = DEFAULT_FORMAT, column: str = "value") -> DataFrame:
    """Requests of log lines: ip (0 if invalid), wall_ts, offset_sec, method, uri, status, bytes, user_agent, bad_status, bad_bytes.

    A field that the format lacks has its zero value. Columns that a query doesn't use are pruned, and
    with them their part of the work; the fields of a line come from one evaluation of the pattern.
    """
    rows, at = _parsed(lines, log_format, column)
    none, f = F.lit(""), lambda code: _field(at, code)
    request, time = f("r"), f("t")
    parts = F.split(request, " +")
    method = f("m") if "m" in at else F.get(parts, F.lit(0))
    uri = f("U") if "U" in at else F.coalesce(F.get(parts, F.lit(1)), none)
    if "U" in at and "r" in at:
        uri = F.when(f("U") != "", f("U")).otherwise(F.coalesce(F.get(parts, F.lit(1)), none))
    status, bad_status = status_of(f("s"))
    size, bad_bytes = bytes_of(f("b"))
    return rows.select(
        "ip", parse_wall(time).alias("wall_ts"), parse_offset(time).alias("offset_sec"), static_method(F.coalesce(method, none)).alias("method"),
        uri.alias("uri"), status.alias("status"), size.alias("bytes"), f("u").alias("user_agent"), bad_status.alias("bad_status"), bad_bytes.alias("bad_bytes"),
    )


def parse_ips(lines: DataFrame, log_format: str = DEFAULT_FORMAT, column: str = "value") -> DataFrame:
    """PRJ-4: addresses alone; the pattern ends after theirs."""
    return _parsed(lines, log_format, column, {"h"})[0].select("ip")
