"""Glob patterns: * any run, ? one character, [set] with ranges and ! or ^ for its complement, \\ takes the next as it is."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = frozenset(".^$*+?()[]{}|\\&~#-")


def _quoted(c: str) -> str:
    return f"\\{c}" if c in _SPECIAL else c


def pieces(pattern: str) -> list[tuple[str, str]]:
    """("text", characters), ("any", ""), ("one", "") or ("set", inside of the brackets)."""
    out: list[tuple[str, str]] = []
    i = 0

    def text(c: str) -> None:
        if out and out[-1][0] == "text":
            out[-1] = "text", out[-1][1] + c
        else:
            out.append(("text", c))

    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if not (out and out[-1][0] == "any"):
                out.append(("any", ""))
        elif c == "?":
            out.append(("one", ""))
        elif c == "[":
            end = i + (pattern[i : i + 1] in ("!", "^"))
            end = pattern.find("]", end + 1)  # a ] in the first place is a member
            if end < 0:
                text(c)
            else:
                out.append(("set", pattern[i:end]))
                i = end + 1
        elif c == "\\" and i < len(pattern):
            text(pattern[i])
            i += 1
        else:
            text(c)
    return out


def _set(inside: str) -> str:
    negated = inside[:1] in ("!", "^")
    body, out, i = inside[negated:], [], 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            i += 1
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            if body[i] <= body[i + 2]:
                out.append(f"{_quoted(body[i])}-{_quoted(body[i + 2])}")
            i += 3
        elif m := re.match(r"\[:(alpha|digit|alnum|upper|lower|space|punct|xdigit):\]", body[i:]):
            out.append({"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"\p{Punct}", "xdigit": "0-9a-fA-F"}[m[1]])
            i += m.end()
        else:
            out.append(_quoted(body[i]))
            i += 1
    if not out:
        return "." if negated else r"(?!)"
    return f"[{'^' if negated else ''}{''.join(out)}]"


def to_regex(pattern: str, icase: bool = False) -> str:
    """The regular expression of a whole match."""
    body = "".join({"any": lambda _: ".*", "one": lambda _: ".", "set": _set, "text": lambda t: "".join(map(_quoted, t))}[kind](t) for kind, t in pieces(pattern))
    return f"(?s{'i' if icase else ''})\\A{body}\\z"


def matches(column: Column, pattern: str, icase: bool = False) -> Column:
    """Whether the whole value matches; plain prefixes, suffixes and infixes need no regular expression and are pushed to scans."""
    found = pieces(pattern)
    kinds, text = [k for k, _ in found], "".join(t for k, t in found if k == "text")
    if not icase:
        if kinds in ([], ["text"]):
            return column == text
        if kinds == ["any"]:
            return column.isNotNull()
        if kinds == ["text", "any"]:
            return column.startswith(text)
        if kinds == ["any", "text"]:
            return column.endswith(text)
        if kinds == ["any", "text", "any"]:
            return column.contains(text)
    return column.rlike(to_regex(pattern, icase))


def fold_ascii(column: Column) -> Column:
    """A-Z for a-z; other letters stay."""
    return F.translate(column, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def fold_literal(text: str) -> str:
    return "".join(c.upper() if "a" <= c <= "z" else c for c in text)
