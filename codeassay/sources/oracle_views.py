"""The derived views again, as SQL for an independent engine."""

from __future__ import annotations

from ..catalog import registries as reg
from .derived import CWE_POOL, ECOSYSTEMS, LICENSES, RULE_POOL, SCAN_ORDERS
from .snippets import samples


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def snippets() -> str:
    items = samples()
    values = ",\n".join(
        f"({i}, {q(e)}, {q(h)}, {n}, {'true' if u else 'false'}, {q(t)})" for i, (e, h, n, u, t) in enumerate(items)
    )
    return f"snip(sid, ext, head, n, up, tail) AS (VALUES {values})"


def _sampled(name, table, key, text, repo, path) -> str:
    token = f"repeat(md5(CAST({key} AS VARCHAR)), 4)"
    return f"""{snippets()},
{name} AS (
  SELECT d.*, {repo} AS repo, {path} AS path,
         {text} || chr(10) || s.head || substr(CASE WHEN s.up THEN upper({token}) ELSE {token} END, 1, s.n) || s.tail AS content
  FROM {table} d JOIN snip s ON s.sid = ({key}) % {len(samples())})"""


def corpus() -> str:
    return _sampled("corpus", "documents", "d.doc_id", "d.text", "d.source", "d.source || '/' || d.lang || '/d' || d.doc_id || s.ext")


def language(path: str = "path") -> str:
    ext = f"lower(regexp_extract({path}, '(\\.[^./\\\\]+)$', 1))"
    cases = " ".join(f"WHEN {q(e)} THEN {q(l)}" for e, l in reg.EXTENSION_LANGUAGE.items())
    return f"CASE {ext} {cases} END"


def lines(source: str = "corpus") -> str:
    return f"""files AS (SELECT * FROM (SELECT *, {language()} AS language FROM {source}) WHERE language IS NOT NULL),
lines AS MATERIALIZED (
  SELECT repo, path, language, unnest(string_split(content, chr(10))) AS text,
         generate_subscripts(string_split(content, chr(10)), 1) AS line_no
  FROM files)"""


def web_corpus() -> str:
    return _sampled("corpus", "pages", "d.page_id * 3", "d.html", "regexp_extract(d.url, '^https?://([^/]+)', 1)", "'p' || d.page_id || '.js'")


def pasted_snippets() -> str:
    return _sampled("corpus", "conversations", "d.conv_id * 5 + d.turn", "d.text", "d.role", "'c' || d.conv_id || '-' || d.turn || '.js'")


def scans() -> str:
    return """scans AS (
  SELECT o_orderkey AS scan_id, o_custkey AS project_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS created_at,
         CAST(trunc(o_totalprice % 20) AS BIGINT) AS critical_count,
         CAST(trunc(o_totalprice % 30) AS BIGINT) AS warning_count,
         CAST(trunc(o_totalprice % 7) AS BIGINT) AS info_count
  FROM orders)"""


def projects() -> str:
    return """projects AS (
  SELECT c_custkey AS project_id, c_nationkey AS user_id,
         'org' || c_nationkey || '/' || lower(c_mktsegment) || '-' || (c_custkey % 100) AS name,
         CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN 'daily' ELSE 'weekly' END AS scan_schedule
  FROM customer)"""


def pkg_cols(k: str) -> str:
    return (
        f"CASE WHEN {k} % 7 = 0 THEN '@s/' ELSE '' END || 'p' || {k} AS name, "
        f"({k} % 9) || '.' || ({k} % 5) || '.0' AS version, "
        f"{sql_list(ECOSYSTEMS)}[{k} % 4 + 1] AS ecosystem"
    )


def dependencies() -> str:
    return f"""deps AS (
  SELECT l_orderkey AS scan_id, {pkg_cols('l_partkey')},
         'm' || (l_suppkey % 3) || '/manifest' AS source, l_linenumber AS line, l_linestatus = 'F' AS dev,
         CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE {sql_list(LICENSES)}[l_partkey % {len(LICENSES)} + 1] END AS license,
         CASE WHEN l_partkey % 3 = 0 THEN '^' || (l_partkey % 9) || '.' || (l_partkey % 5) || '.0' END AS declared_range
  FROM lineitem)"""


def advisories() -> str:
    """Normalised advisories, straight from the columns of part (no JSON)."""
    return f"""adv AS (
  SELECT 'ADV-' || k AS id,
         CASE WHEN k % 6 = 0 THEN 'No summary available' ELSE 'issue in ' || name END AS summary,
         CASE WHEN k % 4 = 0 THEN CASE WHEN sz + 0.5 >= 7 THEN 'critical' WHEN sz + 0.5 >= 4 THEN 'warning' ELSE 'info' END
              WHEN k % 4 = 3 THEN 'warning'
              ELSE ['critical', 'warning', 'info', 'critical'][sz % 4 + 1] END AS severity,
         CASE WHEN k % 4 = 0 THEN sz + 0.5 END AS cvss_score,
         CASE WHEN k % 5 <> 0 THEN sz || '.1.0' END AS fixed_version,
         CASE WHEN k % 2 = 0 THEN 'CVE-2024-' || k ELSE 'ADV-' || k END AS cve,
         name, ecosystem, version, 'https://advisories.example/' || k AS url
  FROM (SELECT p_partkey AS k, p_size % 12 AS sz, {pkg_cols('p_partkey')} FROM part) WHERE k % 3 <> 0)"""


def findings() -> str:
    rule = f"{sql_list(RULE_POOL)}[l_partkey % {len(RULE_POOL)} + 1]"
    return f"""findings AS (
  SELECT l_orderkey AS scan_id, rule_id,
    CASE WHEN rule_id LIKE 'SCA-%' THEN 'Vulnerable dependency: ' || pkg || dv
         WHEN rule_id LIKE 'LICENSE-%' THEN 'Copyleft license: ' || pkg || dv ELSE 'Rule ' || rule_id END AS rule_name,
    CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity,
    ['high', 'medium', 'low'][l_linenumber % 3 + 1] AS confidence,
    CASE WHEN rule_id LIKE 'SCA-%' THEN pkg || '@' || (l_suppkey % 4) || '.0.1' || dv || ' has a known vulnerability'
         ELSE 'finding on ' || pkg END AS message,
    'src/f' || (l_suppkey % 17) || '.js' AS file_path, l_linenumber AS line, CAST(l_quantity AS INT) AS "column",
    CASE WHEN rule_id LIKE 'SCA-%' THEN '[' || {sql_list(ECOSYSTEMS)}[l_partkey % 4 + 1] || '] "' || pkg || '": "' || (l_suppkey % 4) || '.0.1"'
         WHEN rule_id LIKE 'LICENSE-%' THEN '[npm] "' || pkg || '" - License: ' || ['GPL-3.0', 'MPL-2.0'][l_partkey % 2 + 1]
         ELSE '  call( ' || pkg || '  )' END AS snippet,
    {sql_list(CWE_POOL)}[l_partkey % {len(CWE_POOL)} + 1] AS cwe, 'A03:2021' AS owasp, 'Change the code.' AS suggestion,
    CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 = 1 END AS reachable,
    CAST(l_shipdate AS TIMESTAMP) AS created_at,
    l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(l_quantity AS INT) || '-' || l_returnflag || l_linestatus || '-' || strftime(l_shipdate, '%Y%m%d') AS seq
  FROM (SELECT *, {rule} AS rule_id, 'p' || (l_partkey % 50) AS pkg, CASE WHEN l_linestatus = 'F' THEN ' (dev)' ELSE '' END AS dv FROM lineitem))"""


def policies() -> str:
    return """policies AS (
  SELECT 'pol' || k AS policy_id, user_id, CASE WHEN k % 5 = 4 THEN k END AS project_id, 'policy ' || k AS name,
         k % 7 <> 6 AS enabled, ['block', 'warn', 'ignore'][k % 3 + 1] AS action,
         CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' END AS severity_gte,
         CASE WHEN k % 6 = 0 THEN true END AS reachable_only,
         CASE k % 5 WHEN 1 THEN 'sast' WHEN 2 THEN 'sca' WHEN 3 THEN 'license' END AS source,
         CASE WHEN k % 8 = 0 THEN ['CWE-89', 'CWE-22'] END AS cwe_ids,
         k % 9 = 7 AS has_patterns, k % 10 = 2 AS no_dev, k % 11 = 8 AS strong_only
  FROM (SELECT n_nationkey AS user_id, n_nationkey * 2 + v AS k FROM nation, (VALUES (0), (1)) t(v)))"""


def edges() -> str:
    block = f"(l_orderkey // {SCAN_ORDERS})"
    return f"""edges AS (
  SELECT scan_id, 'npm:p' || (base + o) || '@1.0.0' AS parent_key, 'npm:p' || (base + CASE WHEN line = 7 AND o % 8 = 1 THEN o // 3 ELSE o * 3 + line END) || '@1.0.0' AS child_key
  FROM (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE {block} + 1 END AS scan_id, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE {block} * {SCAN_ORDERS} END AS base,
    l_orderkey - CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE {block} * {SCAN_ORDERS} END AS o, l_linenumber AS line FROM lineitem))"""
