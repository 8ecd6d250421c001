"""Registered queries: rule matching, detectors, scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import detectors as cat
from ..sources import derived as d
from ..sources import oracle_views as v
from . import sast_oracle as so
from ..operators.corpus import within_snippet_limit
from ..catalog.model import JS_TS, Rule
from ..operators.matching import FINDING_COLUMNS
from .scan import run_code_rule, scan

OUT = ["repo", "file_path", "line", "column", "rule_id", "severity", "confidence", "message", "snippet"]

QUERIES: dict = {}
ORACLE: dict = {}


def _register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def _scan(**kw):
    return lambda spark, sf: scan(d.corpus(spark, sf), **kw).select(*OUT)


_register("declarative_rules", _scan(detectors=(), secrets=False, dedup=False), so.scan_sql(declarative=True))
_register("secret_rules", _scan(detectors=(), declarative=False, dedup=False), so.scan_sql(secrets=True))
_register(
    "secret_rules_web_pages",
    lambda spark, sf: scan(d.web_corpus(spark, sf), detectors=(), declarative=False, dedup=False).select(*OUT),
    so.scan_sql(secrets=True, source=v.web_corpus()),
)
_register(
    "pasted_snippet_scan",
    lambda spark, sf: scan(within_snippet_limit(d.pasted_snippets(spark, sf))).select(*OUT),
    so.scan_sql(numbers=cat.META, declarative=True, secrets=True, dedup=True, source=v.pasted_snippets()),
)
for _no in sorted(cat.META):
    _name = f"detector_{_no:03d}_" + cat.META[_no][0].lower().replace(" ", "_").replace("-", "_")
    if _no in (13, 16, 18):
        # these report only after structural confirmation
        _register(
            _name,
            _scan(detectors=(_no,), declarative=False, secrets=False, dedup=False, mode="confirm"),
            so.scan_sql(numbers=(_no,), confirm=True),
        )
    else:
        _register(
            _name,
            _scan(detectors=(_no,), declarative=False, secrets=False, dedup=False),
            so.scan_sql(numbers=(_no,)),
        )
    if _no in (6, 9, 10):
        # calls and loops are looked up when these confirm
        _register(
            f"{_name}_confirmed",
            _scan(detectors=(_no,), declarative=False, secrets=False, dedup=False, mode="confirm"),
            so.scan_sql(numbers=(_no,), confirm=True),
        )
_register("scan_all_findings", _scan(dedup=False), so.scan_sql(numbers=cat.META, declarative=True, secrets=True))
_register("scan_deduplicated", _scan(dedup=True), so.scan_sql(numbers=cat.META, declarative=True, secrets=True, dedup=True))
_register(
    "scan_confirmed", _scan(dedup=True, mode="confirm"), so.scan_sql(numbers=cat.META, declarative=True, secrets=True, dedup=True, confirm=True)
)


# ------------------------------------------------------------- user-defined rules
TEAM_PATTERN = r"\bconst\s+\w+\s*=\s*await\b"


def _user_rule(spark, sf):
    rule = Rule(
        "TEAM-AWAIT", "Awaited constant", "info", "low", "CWE-0", "A00", "Awaited constant", "None.", JS_TS, TEAM_PATTERN,
        anti_pattern="axios", anti_scope="window", skip_comments=True,
    )
    return scan(d.corpus(spark, sf), detectors=(), declarative=False, secrets=False, extra_rules=[rule]).select("file_path", "line", "column", "rule_id")


_register(
    "user_declarative_rule",
    _user_rule,
    f"""WITH {v.corpus()}, {v.lines()}, w AS (SELECT path, language, line_no, text, string_agg(text, ' ') OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS nxt FROM lines)
    SELECT path AS file_path, line_no AS line, length(regexp_extract(text, {v.q('(?s)^(.*?)(?:' + TEAM_PATTERN + ')')}, 1)) + 1 AS "column", 'TEAM-AWAIT' AS rule_id
    FROM w WHERE language <> 'python' AND {v.m('text', TEAM_PATTERN)} AND NOT contains(nxt, 'axios') AND NOT {v.m('text', r'^\s*(?://|[*])')}""",
)


def _long_line_rule(frame):
    """A rule in Python: the longest line of every file that has one over 200 characters."""
    import pandas as pd

    rows = []
    for repo, path, content in zip(frame["repo"], frame["path"], frame["content"]):
        lines = content.split("\n")
        size, first = max((len(t), -i) for i, t in enumerate(lines, start=1))
        if size > 200:
            rows.append((repo, path, -first, 1, "TEAM-LONG", "Long line", "info", "low", f"{size} characters", "", "", "", "", "pattern"))
    return pd.DataFrame(rows, columns=list(FINDING_COLUMNS))


_register(
    "user_code_rule",
    lambda spark, sf: run_code_rule(d.corpus(spark, sf), _long_line_rule).select("repo", "file_path", "line", "message"),
    f"""WITH {v.corpus()}, {v.lines()}, r AS (SELECT repo, path, line_no, length(text) AS n, row_number() OVER (PARTITION BY path ORDER BY length(text) DESC, line_no) AS rn FROM lines)
    SELECT repo, path AS file_path, CAST(line_no AS INT) AS line, n || ' characters' AS message FROM r WHERE rn = 1 AND n > 200""",
)
