"""Path globs as regular expressions that Java and RE2 read alike.

``*`` and ``?`` stay within a segment, ``**`` as a whole segment spans any
number of them, ``{a,b}`` are alternatives, ``[...]`` are classes and ``\\``
escapes.  Everything else is literal; matching is case-sensitive and covers
the whole path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WILD = re.compile(r"[*?\[\]{}\\]")


def is_glob(text: str) -> bool:
    """Whether a command-line argument counts as a pattern; braces alone don't."""
    return any(c in text for c in "*?[]")


def alternatives(pattern: str) -> list[str]:
    """The pattern with its outermost brace lists expanded, recursively."""
    depth, start, commas, i = 0, -1, [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "{":
            if depth == 0:
                start, commas = i, []
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0 and commas:
                cuts = [start, *commas, i]
                options = [pattern[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
                return [x for o in options for x in alternatives(pattern[:start] + o + pattern[i + 1 :])]
        elif c == "," and depth == 1:
            commas.append(i)
        i += 1
    return [pattern]


def _segment(text: str) -> str:
    """One segment as a regular expression."""
    if re.fullmatch(r"\*+", text):
        return "[^/]+"
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(re.escape(text[i + 1]))
            i += 2
            continue
        if c == "*":
            while i + 1 < len(text) and text[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := text.find("]", i + 2 + (text[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = text[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            body = re.sub(r"([\[\]\\&~])", r"\\\1", inner[1:] if negated else inner)
            out.append(f"[^/{body}]" if negated else f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _one(pattern: str) -> str:
    segments = [s for k, s in enumerate(pattern.split("/")) if not (s == "**" and k and pattern.split("/")[k - 1] == "**")]
    out = ""
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s == "**":
            out += (".*" if k == 0 else ".+") if last else "(?:[^/]+/)*"
        else:
            out += _segment(s) + ("" if last else "/")
    return out


def glob_to_regex(pattern: str) -> str:
    return r"\A(?s:" + "|".join(f"(?:{_one(p)})" for p in alternatives(pattern)) + r")\z"


def literal_prefix(pattern: str) -> str:
    """The leading segments without wildcards; empty for patterns with braces or none."""
    segments = pattern.split("/")
    if "{" in pattern:
        return ""
    kept = []
    for s in segments[:-1]:
        if _WILD.search(s):
            break
        kept.append(s)
    return "/".join(kept)


def matches(path: Column | str, pattern: str) -> Column:
    """Whether a path matches; a literal prefix becomes a range that reaches the scan, and no wildcard an equality."""
    path = F.col(path) if isinstance(path, str) else path
    if not _WILD.search(pattern):
        return path == pattern
    hit = path.rlike(glob_to_regex(pattern))
    prefix = literal_prefix(pattern)
    # "0" follows "/" in byte order.
    return (path >= prefix + "/") & (path < prefix + "0") & hit if prefix else hit


def matches_any(path: Column | str, patterns: list[str]) -> Column:
    """Whether a path matches one of a handful of patterns, folded into one condition."""
    out = F.lit(False)
    for p in patterns:
        out = out | matches(path, p)
    return out


def first_match(path: Column | str, patterns: list[str]) -> Column:
    """The first pattern in order that matches, or null."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(matches(path, p), F.lit(p)).otherwise(out)
    return out
