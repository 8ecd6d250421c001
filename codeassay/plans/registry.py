"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import (
    queries_corpus, queries_deps, queries_eval, queries_exports, queries_policy, queries_reports, queries_sast, queries_streaming,
)

MODULES = (
    queries_sast, queries_corpus, queries_deps, queries_policy, queries_reports, queries_exports, queries_eval, queries_streaming,
)


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.ORACLE)
    return out
