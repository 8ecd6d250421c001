"""Rule records.  A catalog is plain data; plans turn it into expressions."""

from __future__ import annotations

from dataclasses import dataclass

JS_TS = ("javascript", "typescript")
ALL_LANGUAGES = ("javascript", "typescript", "python")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    severity: str
    confidence: str
    cwe: str
    owasp: str
    message: str
    suggestion: str
    languages: tuple
    pattern: str
    anti_pattern: str | None = None
    #: "window" = current line and the next three, "file" = anywhere in the file
    anti_scope: str | None = None
    #: a second pattern the whole file must contain
    file_requires: str | None = None
    once_per_file: bool = False
    skip_comments: bool = False
    kind: str = "pattern"
    #: cheap literal tests, all implied by ``pattern``; any of them must hold
    anchors: tuple = ()
    #: compare anchors in lower case
    anchors_lower: bool = False
    #: name of a shared family gate (secrets)
    gate: str | None = None
    #: (prefix, token length, upper case?, suffix): a text the pattern matches
    sample: tuple | None = None
