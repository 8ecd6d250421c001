"""Calls and loops of a file in plain SQL: tokens as rows, depth as a running sum, brackets paired by depth.

Checks the bracket index of the confirm stage, and shares nothing with it.
"""

from __future__ import annotations

from ..catalog import detectors as cat
from ..sources.oracle_views import m, q

TOKEN = (
    r"""(?s://[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][0-9A-Za-z_.]*|[ \t\r]+|.)"""
)
CONSTRUCTS = r"cookie\s*\(|for\s*\(|Object\.assign|merge\s*\(|Function\s*\(|redirect|assign|replace|\.send|\.json"
LITERAL = r"""^(?:"[^"\n]*"|'[^'\n]*'|[0-9.][0-9A-Za-z_.]*|true|false|null)$"""
MEMBER = r"[A-Za-z0-9_$]*(?:\s*[.]\s*[A-Za-z0-9_$]+|\s*\[[^\[\]]*\])*$"


def structure(source: str = "files") -> str:
    """CTE ``call_facts``: for lines of files not in Python, flags of the calls that begin there and of open loops around."""
    word = "regexp_matches(t, '^[A-Za-z_$]')"
    calls = "'cookie', 'assign', 'replace', 'redirect', 'Function', 'send', 'json', 'merge', 'defaultsDeep', 'deepmerge'"
    user = lambda parts: m("last", r"^(?:req|request)\s*[.]\s*(?:" + parts + ")" + MEMBER)
    return f"""tok AS MATERIALIZED (
  SELECT path, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT path, regexp_extract_all(content, {q(TOKEN)}) AS l FROM {source} WHERE language <> 'python' AND {m('content', CONSTRUCTS)})),
dep AS MATERIALIZED (
  SELECT *, sum(k) OVER (PARTITION BY path ORDER BY i) AS after, coalesce(1 + sum(length(t) - length(replace(t, chr(10), ''))) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS line,
    NOT regexp_matches(t, '^(?:\\s|//|/\\*)') AS sig
  FROM (SELECT *, CASE WHEN t IN ('(', '[', '{{') THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END AS k FROM tok)),
brk AS MATERIALIZED (
  SELECT path, i, k, lead(i) OVER (PARTITION BY path, after + CASE WHEN k = -1 THEN 1 ELSE 0 END ORDER BY i) AS j FROM dep WHERE k <> 0),
sigs AS (
  SELECT *, lag(t, 1) OVER w AS p1, lag(t, 2) OVER w AS p2, lag(t, 3) OVER w AS p3, lag(t, 4) OVER w AS p4, lag(t, 5) OVER w AS p5, lag(t, 6) OVER w AS p6, lag(t, 7) OVER w AS p7,
    lag(line) OVER w AS line1, lead(t) OVER w AS n1, lead(i) OVER w AS next_i FROM dep WHERE sig WINDOW w AS (PARTITION BY path ORDER BY i)),
begun AS (
  SELECT *, max(CASE WHEN {word} AND (p1 IS NULL OR p1 <> '.' OR line1 <> line) THEN i END) OVER (PARTITION BY path, after ORDER BY i) AS begin FROM sigs),
opened AS (
  SELECT a.path, a.i, b.j, a.after AS level, a.p1 AS last_name, a.p2 = '.' AS member, a.p3, a.p4, c.begin FROM begun a
  JOIN brk b ON b.path = a.path AND b.i = a.i JOIN begun c ON c.path = a.path AND c.next_i = a.i WHERE a.t = '(' AND a.p1 IN ({calls}) AND b.j IS NOT NULL),
call AS MATERIALIZED (SELECT o.*, s.line, s.t AS first_name, coalesce(s.p1, '') = 'new' AS made FROM opened o JOIN sigs s ON s.path = o.path AND s.i = o.begin WHERE coalesce(s.p1, '') <> 'function'),
inside AS MATERIALIZED (
  SELECT c.path, c.i AS call_i, c.level, d.i, d.t, d.after, d.sig, d.t = ',' AND d.after = c.level AS cut,
    sum(CASE WHEN d.t = ',' AND d.after = c.level THEN 1 ELSE 0 END) OVER (PARTITION BY c.path, c.i ORDER BY d.i) AS arg
  FROM call c JOIN dep d ON d.path = c.path AND d.i > c.i AND d.i < c.j),
args AS (
  SELECT path, call_i, arg, trim(string_agg(t, '' ORDER BY i) FILTER (NOT cut AND NOT regexp_matches(t, '^(?://|/\\*)')), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM inside GROUP BY ALL HAVING bool_or(sig AND NOT cut)),
argued AS (SELECT path, call_i, count(*) AS n, list(text ORDER BY arg) AS list, list(text ORDER BY arg)[-1] AS last FROM args GROUP BY ALL),
props AS (
  SELECT path, call_i, prop, trim(string_agg(t, '' ORDER BY i) FILTER (NOT (t = ',' AND after = level + 1) AND i > first AND after > level), ' ' || chr(9) || chr(10) || chr(13)) AS text
  FROM (SELECT *, min(i) FILTER (sig AND NOT cut) OVER (PARTITION BY path, call_i) AS first, sum(CASE WHEN t = ',' AND after = level + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path, call_i ORDER BY i) AS prop FROM inside WHERE arg = 2) GROUP BY ALL),
flags AS (SELECT path, call_i, bool_or({m('text', r'^httpOnly\s*:\s*true$')}) AND bool_or({m('text', r'^secure\s*:\s*true$')}) AS both_set FROM props GROUP BY ALL),
called AS (
  SELECT c.path, c.line,
    last_name = 'cookie' AND member AND NOT made AND (n = 2 OR (n > 2 AND NOT (starts_with(list[3], '{{') AND coalesce(both_set, false)))) AS c13,
    last_name IN ('redirect', 'assign', 'replace') AND member AND coalesce({user('query|params|body|headers')}, false) AS c6,
    last_name = 'Function' AND NOT member AND made AND n > 0 AND NOT {m('last', LITERAL)} AS c9,
    last_name = 'assign' AND member AND p3 = 'Object' AND first_name = 'Object' AND len(list_filter(list, lambda x: {m('x', r'^(?:req|request)\s*[.]\s*(?:query|params|body)' + MEMBER)})) > 0 AS assigned,
    NOT made AND ((last_name IN ('merge', 'deepmerge') AND NOT member) OR (last_name IN ('merge', 'defaultsDeep') AND member AND p3 = '_' AND first_name = '_') OR (last_name = 'merge' AND member AND p3 = 'lodash' AND first_name = 'lodash')) AS merged,
    last_name IN ('send', 'json') AND member AND NOT made AND len(list_filter(list_transform(list, lambda x: {_without_calls('x')}), lambda x: {m('x', r'^(?i:err|error|e)(?:[.](?:stack|message))?$')}
      OR (starts_with(x, '{{') AND {m('x', r'(?:[{,]|:)\s*(?i:err|error|e)(?:[.](?:stack|message))?\s*[,}]')}))) > 0 AS c16
  FROM call c LEFT JOIN argued a ON a.path = c.path AND a.call_i = c.i LEFT JOIN flags f ON f.path = c.path AND f.call_i = c.i),
heads AS (
  SELECT s.path, b.i, b.j, s.after + 1 AS level, s.line, (SELECT string_agg(d.t, '' ORDER BY d.i) FROM dep d WHERE d.path = s.path AND d.i > b.i AND d.i < b.j) AS head,
    (SELECT min(n.i) FROM sigs n WHERE n.path = s.path AND n.i > b.j) AS body
  FROM sigs s JOIN brk b ON b.path = s.path AND b.i = s.next_i WHERE s.t = 'for' AND s.n1 = '(' AND (s.p1 IS NULL OR s.p1 <> '.' OR s.line1 <> s.line) AND b.j IS NOT NULL),
loops AS (
  SELECT h.*, CASE WHEN t.t = '{{' THEN bb.j ELSE (SELECT min(d.i) FROM dep d WHERE d.path = h.path AND d.i >= h.body AND ((d.t IN (';', chr(10)) AND d.after = h.level - 1) OR d.after < h.level - 1)) END AS last
  FROM heads h LEFT JOIN dep t ON t.path = h.path AND t.i = h.body LEFT JOIN brk bb ON bb.path = h.path AND bb.i = h.body
  WHERE regexp_matches(h.head, '(?s)^\\s*(?:(?:const|let|var)\\s+)?(?:[A-Za-z0-9_$.]+|[\\[{{].*[\\]}}])\\s+in\\b')),
guards AS (
  SELECT path, i FROM sigs WHERE n1 = '(' AND ((t = 'hasOwnProperty' AND p1 = '.' AND (p2 = ']' OR regexp_matches(p2, '^[A-Za-z0-9_$]+$')) AND NOT (p2 IN ('this', 'super') AND coalesce(p3, '') <> '.'))
    OR (t = 'hasOwn' AND p1 = '.' AND p2 = 'Object' AND coalesce(p3, '') <> '.')
    OR (t = 'call' AND p1 = '.' AND p2 = 'hasOwnProperty' AND p3 = '.' AND p4 = 'prototype' AND p5 = '.' AND p6 = 'Object' AND coalesce(p7, '') <> '.'))),
open_loops AS (
  SELECT l.path, l.line AS first, d.line AS until FROM loops l JOIN dep d ON d.path = l.path AND d.i = coalesce(l.last, (SELECT max(x.i) FROM dep x WHERE x.path = l.path))
  WHERE NOT EXISTS (SELECT 1 FROM guards g WHERE g.path = l.path AND g.i >= l.body AND g.i <= d.i)),
call_facts AS MATERIALIZED (
  SELECT path, line, bool_or(c13) AS c13, bool_or(c6) AS c6, bool_or(c9) AS c9, bool_or(assigned OR merged) AS c10, bool_or(c16) AS c16 FROM called GROUP BY ALL)"""


def _without_calls(x: str) -> str:
    out = x
    for _ in range(4):
        out = f"regexp_replace({out}, '\\([^()]*\\)', '!', 'g')"
    return out


def flagged_lines() -> str:
    """``lws``: the lines of ``lw`` with the flags."""
    return """lws AS (
  SELECT lw.*, coalesce(f.c6, false) AS c6, coalesce(f.c9, false) AS c9, coalesce(f.c10, false) AS c10, coalesce(f.c13, false) AS c13, coalesce(f.c16, false) AS c16,
    EXISTS (SELECT 1 FROM open_loops o WHERE o.path = lw.path AND lw.line_no BETWEEN o.first AND o.until) AS in_loop
  FROM lw LEFT JOIN call_facts f ON f.path = lw.path AND f.line = lw.line_no)"""


def confirmed(number: int) -> str | None:
    """Condition on a flagged line; None for detectors whose structure is not looked at."""
    href = m("text", r"[.]href\s*=\s*(?:req|request)[.](?:params|query|body|headers)\b[A-Za-z0-9_$.]*\s*(?:[;,)}]|$)")
    return {
        6: f"{m('text', cat.REDIRECT)} AND (c6 OR {href})",
        9: f"{m('text', cat.FUNCTION_CONSTRUCTOR)} AND c9",
        10: f"{m('text', cat.PROTOTYPE)} AND (in_loop OR c10 OR {m('text', r'[.]__proto__\b')} OR {m('text', r'[.]constructor[.]prototype\b')})",
        13: f"{m('text', cat.COOKIE)} AND c13",
        16: f"{m('text', cat.ERROR_EXPOSURE)} AND c16",
    }.get(number)
