"""Static scan in plain SQL: windows and unions instead of arrays, used to
check the scan plan."""

from __future__ import annotations

from ..catalog import detectors as cat, registries as reg
from ..catalog.js_rules import APP_CONSTRUCTOR, js_rules
from ..catalog.model import ALL_LANGUAGES, JS_TS
from ..catalog.secrets import secret_rules
from ..functions.regex import alternation
from ..sources import oracle_views as v
from . import confirm_oracle as co, structure_oracle as st
from ..sources.oracle_views import m, q

PY = ("python",)


def _or(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def _nearby(cat_name: str) -> str:
    return f"bool_or(san_{cat_name}) OVER w52"


def _window_flags() -> str:
    cols = []
    for c in ("xss", "cmd", "path", "ssrf"):
        test = m("text", alternation(reg.js_sanitizer_names(c)))
        if c == "path":
            test = f"({test} OR {m('text', reg.JS_PATH_MITIGATION)})"
        cols.append(f"{test} AS san_{c}")
    return ", ".join(cols)


def context_lines() -> str:
    """lw: every line with its windows and the file's Python facts."""
    san = lambda c: m("rhs", alternation(reg.py_sanitizer_names(c)))
    quoted = m("text", r"^\s*(\w+)\s*=\s*(?:shlex\.quote|pipes\.quote|quote)\s*\(")
    return f"""flagged AS MATERIALIZED (SELECT *, {_window_flags()} FROM lines),
asg AS MATERIALIZED (
  SELECT path, text, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k,
         regexp_extract(text, '^\\s*(\\w+)\\s*=', 1) AS v, substr(text, strpos(text, '=') + 1) AS rhs
  FROM lines WHERE language = 'python' AND {m('text', r'^\s*\w+\s*=')}),
rec AS (
  WITH RECURSIVE r(path, k, s) AS (
    SELECT path, CAST(0 AS BIGINT), list_filter(list(DISTINCT CASE WHEN {m('rhs', reg.PY_INPUT)} THEN v END), lambda x: x IS NOT NULL)
    FROM asg GROUP BY path
    UNION ALL
    SELECT r.path, r.k + 1,
           CASE WHEN NOT list_contains(r.s, a.v) AND list_has_any(r.s, regexp_extract_all(a.rhs, '\\w+'))
                THEN list_append(r.s, a.v) ELSE r.s END
    FROM r JOIN asg a ON a.path = r.path AND a.k = r.k + 1)
  SELECT path, arg_max(s, k) AS src FROM r GROUP BY path),
facts AS MATERIALIZED (
  SELECT rec.path, src,
    coalesce(list(v) FILTER (WHERE {san('xss')}), []) AS sxss,
    coalesce(list(v) FILTER (WHERE {san('path')}), []) AS spath,
    coalesce(list(v) FILTER (WHERE {san('ssrf')}), []) AS sssrf,
    coalesce(list(v) FILTER (WHERE {quoted}), []) AS quoted,
    coalesce(list(v) FILTER (WHERE {m('rhs', cat.SQL_WORDS)} AND {m('rhs', r"[+]|[.]format\s*\(|f[\"']")}), []) AS sqlvars
  FROM rec JOIN asg USING (path) GROUP BY rec.path, src),
live AS MATERIALIZED (
  SELECT path, src, sxss, quoted, sqlvars,
    list_filter(src, lambda x: NOT list_contains(spath, x)) AS live_path,
    list_filter(src, lambda x: NOT list_contains(sssrf, x)) AS live_ssrf,
    list_filter(src, lambda x: NOT list_contains(quoted, x)) AS live_cmd
  FROM facts),
lw AS MATERIALIZED (
  SELECT f.repo, f.path, f.language, f.line_no, f.text,
    string_agg(f.text, ' ') OVER (PARTITION BY f.path ORDER BY f.line_no ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS nxt,
    string_agg(f.text, ' ') OVER (PARTITION BY f.path ORDER BY f.line_no ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS guard,
    lower(string_agg(f.text, ' ') OVER (PARTITION BY f.path ORDER BY f.line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS around,
    {', '.join(f"{_nearby(c)} AS near_{c}" for c in ('xss', 'cmd', 'path', 'ssrf'))},
    list_has_any(coalesce(l.sxss, []), words) AS t_sxss,
    list_has_any(coalesce(l.live_path, []), words) AS t_path,
    list_has_any(coalesce(l.live_ssrf, []), words) AS t_ssrf,
    list_has_any(coalesce(l.live_cmd, []), words) AS t_cmd,
    list_has_any(coalesce(l.quoted, []), words) AS t_quoted,
    list_has_any(coalesce(l.quoted, []), regexp_extract_all(f.text, '\\(\\s*(\\w+)\\b', 1)) AS q_first,
    list_contains(coalesce(l.sqlvars, []), regexp_extract(f.text, {q(cat.SQL_PY_VARIABLE)}, 1)) AS q_sql
  FROM (SELECT *, regexp_extract_all(text, '\\w+') AS words FROM flagged) f LEFT JOIN live l ON l.path = f.path
  WINDOW w52 AS (PARTITION BY f.path ORDER BY f.line_no ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING))"""


# one entry per way to report: (rule number, languages, condition, outcomes)
def _emissions(numbers, confirm=False) -> list:
    t = "text"
    out = []

    def add(no, languages, cond, *outcomes, column=None):
        if no in numbers:
            out.append((f"SG-{no:03d}", languages, cond, outcomes, column, False))

    also = lambda test: f" AND {test}" if confirm else ""

    def flat(no, languages, cond, message=None):
        add(no, languages, cond, (None, cat.META[no][1], "high", message or cat.META[no][0]))

    web, src = m(t, reg.PY_INPUT_WEB), m(t, reg.PY_INPUT)
    flat(1, ALL_LANGUAGES, f"{_or(m(t, p) for p in cat.SECRET_SHAPES)} AND NOT {m(t, cat.SECRET_ENV)} AND NOT {m(t, cat.SECRET_PLACEHOLDER)}")
    for label, p in cat.SQL_JS:
        add(2, JS_TS, m(t, p) + also(co.sql_js(label)), (m("guard", reg.NUMERIC_GUARD), "critical", "medium", f"SQL injection: {label}"),
            (None, "critical", "high", f"SQL injection: {label}"))
    if confirm:
        per_line = _or(f"({m(t, p)} AND {co.sql_js(label)})" for label, p in cat.SQL_JS)
        several = "SQL injection: template over several lines"
        add(2, JS_TS, f"template_start AND NOT {per_line}", (None, "critical", "high", several))
    skip = f"({m(t, cat.SQL_PY_BOUND)} OR ({m(t, cat.SQL_PY_STATIC)} AND NOT contains(text, '%s')))"
    inline = _or(m(t, p) for p in cat.SQL_PY_INLINE)
    strong = "SQL injection: query text from user data"
    add(2, PY, f"NOT {skip} AND {inline}", (src, "critical", "high", strong), (None, "critical", "medium", "SQL injection: dynamic query text"))
    add(2, PY, f"NOT {skip} AND NOT {inline} AND {m(t, cat.SQL_PY_VARIABLE)} AND q_sql", (None, "critical", "high", strong))
    for label, p in cat.XSS_JS:
        add(3, JS_TS, m(t, p) + also(co.xss_js(label)), ("near_xss", "warning", "medium", f"XSS: {label}"), (None, "warning", "high", f"XSS: {label}"))
    seen = []
    for label, p in cat.XSS_PY:
        cond = f"{m(t, p)} AND NOT (t_sxss AND NOT {web})" + "".join(f" AND NOT {s}" for s in seen)
        seen.append(m(t, p))
        add(3, PY, cond, (web, "critical", "high", f"XSS: {label}"), (None, "critical", "medium", f"XSS: {label}"))
    checksum = f"{m('around', cat.CRYPTO_CHECKSUM)} AND NOT {m('around', cat.CRYPTO_PASSWORD)}"
    for label, p in cat.CRYPTO:
        outs = [(None, "warning", "high", f"Weak cryptography: {label}")]
        if label in ("MD5", "SHA1"):
            outs.insert(0, (checksum, "warning", "medium", f"Weak cryptography: {label}"))
        add(4, ALL_LANGUAGES, m(t, p) + also(co.crypto(label)), *outs)
    flat(6, JS_TS, st.confirmed(6) if confirm else m(t, cat.REDIRECT))
    flat(7, JS_TS, m(t, cat.JWT_LITERAL))
    flat(8, JS_TS, m(t, cat.JWT_NONE) + co.also(8, confirm))
    flat(9, JS_TS, st.confirmed(9) if confirm else m(t, cat.FUNCTION_CONSTRUCTOR))
    flat(10, JS_TS, st.confirmed(10) if confirm else m(t, cat.PROTOTYPE))
    flat(11, JS_TS, m(t, cat.NOSQL) + co.also(11, confirm))
    near = lambda no, c, sev, msg, cond: add(no, JS_TS, cond, (f"near_{c}", sev, "medium", msg), (None, sev, "high", msg))
    near(12, "ssrf", "critical", "SSRF: request to a user-controlled address", m(t, cat.SSRF_JS) + co.also(12, confirm))
    add(12, PY, f"{m(t, cat.SSRF_PY)} AND NOT {m(t, cat.PY_PLAIN_LITERAL)}",
        (f"({src} OR t_ssrf)", "critical", "high", "SSRF: user data in a request address"),
        (None, "critical", "medium", "SSRF: dynamic request address"))
    flat(14, JS_TS, m(t, cat.CORS) + co.also(14, confirm))
    flat(15, ALL_LANGUAGES, f"{m(t, cat.REGEX_PRESENT)} AND {_or(m(t, p) for p in cat.REDOS)}")
    flat(17, JS_TS, m(t, cat.TLS_OFF) + co.also(17, confirm))
    if confirm:
        add(19, JS_TS, m(t, co.DEBUGGER), (None, cat.META[19][1], "high", cat.META[19][0]), column="debugger")
    else:
        flat(19, JS_TS, m(t, cat.DEBUGGER))
    for label, p in cat.DESERIALIZE:
        flat(20, ALL_LANGUAGES, m(t, p), f"Unsafe deserialization: {label}")
    near(21, "path", "critical", "Path traversal: user data in a file path", f"({m(t, cat.PATH_JS)} OR {m(t, cat.PATH_JOIN_JS)})" + co.also(21, confirm))
    add(21, PY, f"{m(t, cat.PATH_PY_OPEN)} AND NOT {m(t, cat.PATH_PY_LITERAL)} AND ({src} OR {m(t, cat.PATH_PY_DYNAMIC)} OR t_path)",
        (src, "critical", "high", "Path traversal: user data in open()"), (None, "critical", "medium", "Path traversal: user data in open()"))
    near(22, "cmd", "critical", "Command injection: user data in a command", m(t, cat.COMMAND_JS) + co.also(22, confirm))
    safe = f"({m(t, r'\(\s*\[')} OR {m(t, cat.PY_PLAIN_LITERAL)} OR q_first OR (t_quoted AND NOT t_cmd))"
    add(22, PY, f"{m(t, cat.COMMAND_PY)} AND NOT {safe}",
        (f"({src} OR t_cmd)", "critical", "high", "Command injection: user data in a shell command"),
        (None, "warning", "medium", "Command injection: dynamic value in a shell command"))
    flat(23, JS_TS, m(t, cat.EVAL_JS) + co.also(23, confirm))
    add(23, PY, f"{m(t, cat.EVAL_PY)} AND NOT {m(t, cat.EVAL_PY_LITERAL)}",
        (src, "critical", "high", "Eval injection: user data evaluated"), (None, "critical", "medium", "Eval injection: dynamic text evaluated"))
    for label, p in cat.LEGACY:
        flat(5, ALL_LANGUAGES, m(t, p) + also(co.legacy()), f"Unsafe access: {label}")
    if confirm:
        flat(13, JS_TS, st.confirmed(13))
        flat(16, JS_TS, st.confirmed(16))
        names = "(?:password|secret|token|hash|key|signature|apikey|api_key|digest|hmac)"
        left = rf"(?i)(?:^|[^\w$]){names}\s*(?:===|!==|==|!=)"
        right = rf"(?i)(?:===|!==|==|!=)\s*(?:[\w$]+[.])*{names}\s*(?:[^\w$.(\[\s]|$)"
        flat(18, JS_TS, f"{m(t, cat.TIMING)} AND ({m(t, left)} OR {m(t, right)})")
    return sorted(out, key=lambda e: cat.ORDER.index(int(e[0][3:])))


def _declarative() -> list:
    out = []
    for r in js_rules():
        cond = f"{m('text', r.pattern)} AND NOT {m('text', r'^\s*(?://|\*)')}"
        if r.anti_scope == "window":
            cond += f" AND NOT {m('nxt', r.anti_pattern)}"
        if r.anti_scope == "file":
            cond = f"line_no = (SELECT min(line_no) FROM app_lines a WHERE a.path = lw.path)"
        out.append((r.rule_id, r.languages, cond, [(None, r.severity, r.confidence, r.message)], r.pattern, False))
    return out


def app_lines() -> str:
    r = next(x for x in js_rules() if x.anti_scope == "file")
    return f"""app_lines AS MATERIALIZED (
  SELECT l.path, l.line_no FROM lines l JOIN files f ON f.path = l.path
  WHERE l.language <> 'python' AND {m('f.content', APP_CONSTRUCTOR)} AND NOT {m('f.content', r.anti_pattern)}
    AND {m('l.text', r.pattern)} AND NOT {m('l.text', r'^\s*(?://|\*)')})"""


def _secrets() -> list:
    return [
        (r.rule_id, r.languages, m("text", r.pattern), [(None, r.severity, r.confidence, r.message)], r.pattern, True)
        for r in secret_rules()
    ]


def _struct(rule_id, sev, conf, msg, pattern, secret, seq) -> str:
    column = "1" if pattern is None else f"length(regexp_extract(text, {q('(?s)^(.*?)(?:' + pattern + ')')}, 1)) + 1"
    snippet = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    if secret:
        hit = f"regexp_extract(text, {q(pattern)}, 0)"
        snippet = f"replace({snippet}, {hit}, substr({hit}, 1, 4) || '****')"
    return (
        f"{{'rule_id': {q(rule_id)}, 'severity': {q(sev)}, 'confidence': {q(conf)}, 'message': {q(msg)}, "
        f"'col': {column}, 'snippet': {snippet}, 'seq': {seq}}}"
    )


def scan_sql(*, numbers=(), declarative=False, secrets=False, dedup=False, source=None, confirm=False) -> str:
    emissions = []
    if numbers:
        emissions += _emissions(set(numbers), confirm)
    if declarative:
        emissions += _declarative()
    if secrets:
        emissions += _secrets()
    cells = []
    for seq, (rule_id, languages, cond, outcomes, pattern, secret) in enumerate(emissions):
        gate = "" if len(languages) == 3 else ("language = 'python' AND " if languages == PY else "language <> 'python' AND ")
        value = "CASE " + " ".join(
            f"WHEN {w or 'true'} THEN {_struct(rule_id, s, c, msg, pattern, secret, seq)}" for w, s, c, msg in outcomes
        ) + " END"
        cells.append(f"CASE WHEN {gate}{cond} THEN {value} END")
    context = bool(numbers) or declarative
    ctes = [source or v.corpus(), v.lines()]
    if context:
        ctes.append(context_lines())
    if declarative:
        ctes.append(app_lines())
    base = "lw" if context else "lines lw"
    if confirm:
        ctes += [st.structure(), st.flagged_lines(), co.js_names(), co.named_lines("lws")]
        base = "lwn lw"
    ctes.append(
        f"hits AS (SELECT repo, path, line_no, unnest(list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL)) AS h FROM {base})"
    )
    select = """SELECT repo, path AS file_path, line_no AS line, h.col AS "column", h.rule_id AS rule_id, h.severity AS severity,
       h.confidence AS confidence, h.message AS message, h.snippet AS snippet"""
    if dedup:
        rank = "CASE h.severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
        ctes.append(
            f"best AS (SELECT *, row_number() OVER (PARTITION BY repo, path, line_no ORDER BY {rank}, -length(h.rule_id), h.seq) AS rn FROM hits)"
        )
        return f"WITH {', '.join(ctes)} {select} FROM best WHERE rn = 1"
    return f"WITH {', '.join(ctes)} {select} FROM hits"
