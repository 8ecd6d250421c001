"""Regex portability.

Rule patterns are written once, in the common subset of the JavaScript, Java
and RE2 dialects.  Java 17 treats any Unicode letter as a word character in
``\\b`` while JavaScript and RE2 only know ASCII, so patterns are rewritten
before they reach Spark.
"""

from __future__ import annotations

import re

_BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def spark_regex(pattern: str) -> str:
    """ASCII word boundaries for Java; everything else is left alone."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == r"\b" and not in_class:
                nxt = pattern[i + 2 : i + 3]
                out.append(r"(?<!\w)" if re.match(r"[A-Za-z0-9_]", nxt) else _BOUNDARY)
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def alternation(names, tail: str = r"\s*\(") -> str:
    """``\\b(?:a\\.b|c)\\s*\\(`` for a list of literal names."""
    body = "|".join(n.replace(".", r"\.") for n in names)
    return rf"\b(?:{body}){tail}"
