"""IPv4 addresses and prefixes as columns of longs. Address 0 stands for an invalid one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_STRICT = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_CIDR = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}/(?:3[0-2]|[12]?\d)$"


def ip_to_long(text: Column, parts: Column | None = None) -> Column:
    """PRJ-6, lenient: 7 to 15 characters, three dots, digits, octets up to 255; leading zeros are read, an empty octet is 0. Anything else is 0.

    parts: the text split at its dots, where a plan has that in a column already (see once()).
    """
    parts = octets(text) if parts is None else parts
    octet = [F.when(p == "", 0).otherwise(p.try_cast("int")) for p in (F.get(parts, F.lit(i)) for i in range(4))]
    value = sum((o.cast("long") * (1 << (24 - 8 * i)) for i, o in enumerate(octet)), F.lit(0).cast("long"))
    fits = F.length(text).between(7, 15) & text.rlike(r"^\d*\.\d*\.\d*\.\d*\z") & (F.greatest(*octet) <= 255)
    return F.when(F.coalesce(fits, F.lit(False)), value).otherwise(F.lit(0).cast("long"))


def octets(text: Column) -> Column:
    return F.split(text, r"\.")


def strict_ip_to_long(text: Column) -> Column:
    """The live rule: no leading zeros, no empty octets. Null if it isn't an address."""
    return F.when(text.rlike(_STRICT.replace("$", r"\z")), ip_to_long(text))


def long_to_ip(ip: Column) -> Column:
    """PRJ-13."""
    return F.concat_ws(".", *[F.shiftrightunsigned(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def cidr_text(start: Column, length: Column) -> Column:
    """PRJ-14."""
    return F.concat(long_to_ip(start), F.lit("/"), length.cast("string"))


def prefix_of(ip: Column, length: Column | int) -> Column:
    """The first ``length`` bits of an address, as a number."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.call_function("shiftright", ip, F.lit(32) - length)


def size_of(length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - length)


def is_cidr(text: Column) -> Column:
    return F.coalesce(text.rlike(_CIDR.replace("$", r"\z")), F.lit(False))


def is_cidr_or_ip(text: Column) -> Column:
    """PRJ-16: IPv4 only; anything with a colon is refused."""
    return is_cidr(text) | F.coalesce(text.rlike(_STRICT.replace("$", r"\z")), F.lit(False))


def cidr_bounds(text: Column, host: bool = False) -> tuple[Column, Column, Column]:
    """PRJ-15: start, end and length of a prefix; nulls if it isn't one. host: the start is the address as it is written."""
    ok = is_cidr(text)
    ip = F.when(ok, ip_to_long(F.split_part(text, F.lit("/"), F.lit(1))))
    length = F.when(ok, F.split_part(text, F.lit("/"), F.lit(2)).try_cast("int"))
    size = size_of(length)
    network = ip - F.pmod(ip, size)
    return (ip if host else network), network + size - 1, length


def subnet24(address: Column) -> Column:
    """PRJ-20: the /24 of a dotted address, for labels."""
    return F.regexp_replace(address, r"^(\d+\.\d+\.\d+)\.\d+\z", "$1.0/24")


def octet(ip: Column, i: int) -> Column:
    """PRJ-21: the i-th octet, from 1."""
    return F.shiftrightunsigned(ip, 32 - 8 * i).bitwiseAND(F.lit(255)).cast("int")


# The same on the driver, for lists and state that are small by nature.


def parse_cidr(text: str, host: bool = False) -> tuple[int, int, int] | None:
    """start, end, length."""
    if not re.fullmatch(_CIDR.strip("^$"), text, re.A):
        return None
    address, length = text.split("/")
    ip = parse_ip(address)
    size = 1 << (32 - int(length))
    network = ip - ip % size
    return (ip if host else network), network + size - 1, int(length)


def parse_ip(text: str) -> int | None:
    if not re.fullmatch(_STRICT.strip("^$"), text, re.A):
        return None
    value = 0
    for part in text.split("."):
        value = value * 256 + int(part)
    return value


def format_ip(ip: int) -> str:
    return ".".join(str(ip >> s & 255) for s in (24, 16, 8, 0))


def format_cidr(start: int, length: int) -> str:
    return f"{format_ip(start)}/{length}"
