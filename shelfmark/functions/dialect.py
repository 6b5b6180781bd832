"""Pattern dialects: shell globs and Python regular expressions as Java patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import java_regex

_WILDCARDS = "*?["


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() or ch in "_/" or ord(ch) > 127 else "\\" + ch


def _bracket(body: str) -> str:
    """A Java character class for the inside of ``[...]``; ranges that run
    backwards are empty, and an empty class matches nothing."""
    negated = body.startswith("!")
    if negated:
        body = body[1:]
    items: list[str] = []
    at = 0
    while at < len(body):
        if at + 2 < len(body) and body[at + 1] == "-":
            low, high = body[at], body[at + 2]
            if low <= high:
                items.append(f"{_quoted(low)}-{_quoted(high)}")
            at += 3
        else:
            items.append(_quoted(body[at]))
            at += 1
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def glob_to_regex(pattern: str) -> str:
    """The Java pattern of a case-sensitive full-path glob; ``*`` also crosses ``/``."""
    out: list[str] = []
    at = 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            # A closing bracket directly after the opening (or after '!') is literal.
            first = at + 2 if pattern[at + 1 : at + 2] == "!" else at + 1
            close = pattern.find("]", first + 1)
            if close < 0:
                out.append(r"\[")
            else:
                out.append(_bracket(pattern[at + 1 : close]))
                at = close
        else:
            out.append(_quoted(ch))
        at += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_prefix(pattern: str) -> str:
    """The whole folders a glob names literally, before its first wildcard."""
    stop = next((i for i, ch in enumerate(pattern) if ch in _WILDCARDS), len(pattern))
    return pattern[: pattern.rfind("/", 0, stop) + 1]


def matches_glob(path: Column, pattern: str) -> Column:
    """Glob test that a Parquet scan can help with: the literal part of the pattern
    goes down as a prefix or equality, only the rest needs the regex."""
    if not any(ch in pattern for ch in _WILDCARDS):
        return path == pattern
    prefix = glob_prefix(pattern)
    if pattern == "*":
        return path.isNotNull()
    test = path.rlike(glob_to_regex(pattern))
    return F.startswith(path, F.lit(prefix)) & test if prefix else test


def python_regex(pattern: str, ignore_case: bool = False) -> str:
    """A Python ``re`` pattern as a Java one. Raises ``ValueError`` when invalid."""
    return java_regex(pattern, ignore_case)


def is_literal(pattern: str) -> bool:
    """True when a regex is plain words, so a page can be tested before its lines."""
    return bool(re.fullmatch(r"[A-Za-z0-9 _,;:'\"/@#%&=-]+", pattern))
