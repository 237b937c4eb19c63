"""FLT-2, 3, 5: regular expressions of the linear-time dialect, rewritten for java.util.regex, and literals they require."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: POSIX classes as they are named here and in Java.
POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}
_SPECIAL = set("\\.+*?()|[]{}^$")


class RegexError(ValueError):
    pass


def to_java(pattern: str) -> str:
    """The same language for Java: $ is the very end unless (?m) is on, POSIX classes get their names there.

    Refused, as the dialect has none: back-references, look-around, possessive and atomic groups. Also the
    flag U, which means something else in Java.
    """
    out, i, in_class, multiline = [], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if not nxt:
                raise RegexError("trailing backslash")
            if nxt.isdigit() and nxt != "0" and not in_class or nxt == "k":
                raise RegexError("back-references are not supported")
            if nxt in "GZ":
                raise RegexError(f"\\{nxt} is not supported")
            if nxt == "C":
                raise RegexError(r"\C is not supported")
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            if c == "[" and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
                if m[2] not in POSIX:
                    raise RegexError(f"unknown class [:{m[2]}:]")
                name = POSIX[m[2]]
                out.append(name.swapcase()[0] + name[1:] if m[1] and name == r"\w" else name.replace(r"\p", r"\P") if m[1] else name)
                i += len(m[0])
                continue
            if c == "[" or c == "&" and pattern[i : i + 2] == "&&":
                out.append("\\" + c)  # Java nests classes and intersects them
                i += 1
                continue
            in_class = c != "]"
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            if re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]):
                raise RegexError("look-around and atomic groups are not supported")
            if m := re.match(r"\(\?P<(\w+)>", pattern[i:]):
                out.append(f"(?<{m[1].replace('_', 'U')}>")
                i += len(m[0])
                continue
            if m := re.match(r"\(\?([a-zA-Z-]*)([:)])", pattern[i:]):
                if "U" in m[1]:
                    raise RegexError("the flag U is not supported")
                on, _, off = m[1].partition("-")
                multiline = "m" in on or multiline and "m" not in off
            out.append(c)
        elif c == "$" and not multiline:
            out.append(r"\z")
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise RegexError("possessive quantifiers are not supported")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise RegexError("missing ]")
    try:
        re.compile(re.sub(r"\\z", r"\\Z", re.sub(r"\\[pP](?:\{\w+\}|\w)", "a", "".join(out))).replace("(?<", "(?P<"))
    except re.error as e:
        raise RegexError(str(e)) from None
    return "".join(out)


def alternatives(pattern: str) -> list[str] | None:
    """The literals of which a plain pattern is an alternation; None if it is more than that."""
    text = re.sub(r"\\([^\w\s])", lambda m: chr(0xE000 + ord(m[1])), pattern)
    if any(c in _SPECIAL - {"|"} for c in text):
        return None
    parts = ["".join(chr(ord(c) - 0xE000) if 0xE000 <= ord(c) < 0xE080 else c for c in p) for p in text.split("|")]
    return parts if all(parts) else None


def required_literal(pattern: str) -> str | None:
    """The longest run of plain characters that every match must hold, of at least three; None if none is sure."""
    if re.search(r"[|(\[{\\]|\(\?", pattern):
        return None
    runs = re.split(r"[.^$]|.[*?]", pattern.replace("+", "\0"))
    runs = [r for run in runs for r in run.split("\0")]
    best = max(runs, key=len, default="")
    return best if len(best) >= 3 else None


def matches(column: Column, pattern: str | None) -> Column | None:
    """Whether the pattern is found anywhere; an empty or missing value never matches. No pattern: None, and all pass.

    Alternations of literals become contains(); a literal that a match must hold is looked for first.
    """
    if not pattern:
        return None
    java = to_java(pattern)
    if (plain := alternatives(pattern)) is not None:
        found = F.lit(False)
        for p in plain:
            found = found | F.contains(column, F.lit(p))
    elif (sure := required_literal(pattern)) is not None:
        found = F.contains(column, F.lit(sure)) & column.rlike(java)
    else:
        found = column.rlike(java)
    return F.coalesce((column != "") & found, F.lit(False))
