"""What the confirm stage asks of a line besides calls and loops, in plain SQL."""

from __future__ import annotations

from ..catalog import detectors as cat, registries as reg
from ..sources.oracle_views import m, q

REQ = r"(?:req|request)[.](?:params|query|body|headers)\b[\w.$]*"
REQ3 = r"(?:req|request)[.](?:params|query|body)\b[\w.$]*"
INPUT = r"(?:req|request)[.](?:params|query|body|headers)[\w.$]*\s*(?:[;,\n)]|$)"
CATEGORIES = ("xss", "sql", "cmd", "path", "ssrf")
WORDS = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b"


def _names(category: str) -> str:
    return "|".join(n.replace(".", "[.]") for n in reg.js_sanitizer_names(category))


def _own_names(category: str) -> str:
    return "|".join(n.replace(".", "[.]") for n in reg.js_sanitizer_names(category, with_universal=False))


def js_names() -> str:
    """CTE ``jsf``: names of a file that hold input and names that hold sanitized values; ``tpl``: unsafe SQL templates over lines."""
    plain = q(rf"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*{INPUT}")
    group = q(rf"(?:const|let|var)\s*\{{([^}}]*)\}}\s*=\s*{INPUT}")
    part = q(r"^\s*(?:[\w$]+\s*:\s*)?([A-Za-z_$][\w$]*)\s*$")
    clean = lambda c: (f"regexp_extract_all(content, {q(rf'(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:{_own_names(c)})\s*\(')}, 1)" if _own_names(c) else "CAST([] AS VARCHAR[])") + f" AS clean_{c}"
    unsafe = f"len(list_filter(regexp_extract_all(s, '\\$\\{{([^}}]*)\\}}', 1), lambda e: NOT {m('e', r'^\s*(?:' + _names('sql') + r')\s*\(')} AND NOT list_contains(clean_sql, trim(e)))) > 0"
    return f"""jsf AS MATERIALIZED (
  SELECT path, content, list_concat(regexp_extract_all(content, {plain}, 1), list_filter(list_transform(flatten(list_transform(regexp_extract_all(content, {group}, 1), lambda g: string_split(g, ','))),
    lambda p: regexp_extract(p, {part}, 1)), lambda x: x <> '')) AS source, {', '.join(clean(c) for c in CATEGORIES)} FROM files WHERE language <> 'python'),
tpl AS (
  SELECT path, line FROM (SELECT path, s, k, clean_sql, coalesce(1 + sum(length(s) - length(replace(s, chr(10), ''))) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS line
    FROM (SELECT path, clean_sql, unnest(string_split(content, '`')) AS s, generate_subscripts(string_split(content, '`'), 1) AS k FROM jsf))
  WHERE k % 2 = 0 AND contains(s, chr(10)) AND contains(s, '${{') AND {m('s', WORDS)} AND {unsafe})"""


def named_lines(base: str) -> str:
    """``lwn``: lines with the names of their file that stand on them, and whether an unsafe template begins."""
    on_line = lambda c: f"list_intersect(coalesce(j.clean_{c}, []), words) AS n_{c}"
    live = lambda c: f"list_filter(list_intersect(coalesce(j.source, []), words), lambda x: NOT list_contains(coalesce(j.clean_{c}, []), x)) AS live_{c}"
    return f"""lwn AS MATERIALIZED (
  SELECT l.*, {', '.join(on_line(c) for c in CATEGORIES)}, {', '.join(live(c) for c in ('path', 'ssrf'))}, EXISTS (SELECT 1 FROM tpl WHERE tpl.path = l.path AND tpl.line = l.line_no) AS template_start
  FROM (SELECT *, regexp_extract_all(text, '\\w+') AS words FROM {base}) l LEFT JOIN jsf j ON j.path = l.path)"""


def _all(pattern: str) -> str:
    return f"regexp_extract_all(text, {q(pattern)}, 1)"


def _template(c: str) -> str:
    return f"len(list_filter({_all(r'\$\{([^}]*)\}')}, lambda e: NOT {m('e', r'^\s*(?:' + _names(c) + r')\s*\(')} AND NOT list_contains(n_{c}, trim(e)))) > 0"


def _added(c: str) -> str:
    return f"len(list_filter({_all(r'\+\s*([A-Za-z_$][\w$.]*\s*\(?)')}, lambda e: NOT {m('e', r'^(?:' + _names(c) + r')\s*\(')} AND NOT list_contains(n_{c}, trim(e)))) > 0"


def _any(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def sql_js(label: str) -> str:
    return _added("sql") if label.startswith("String") else _template("sql")


def xss_js(label: str) -> str:
    t = "text"
    fixed = m(t, r"[.](?:inner|outer)HTML\s*=\s*(?:\"[^\"]*\"|'[^']*'|\d+|true|false|null)\s*(?:[;,)}]|$)")
    cleaned = m(t, r"[.](?:inner|outer)HTML\s*=\s*(?:" + _names("xss") + r")\s*\(")
    assigned = f"(NOT {fixed} AND NOT {cleaned} AND NOT list_has_any(n_xss, {_all(r'[.](?:inner|outer)HTML\s*=\s*([A-Za-z_$][\w$]*)\s*(?:[;,)}]|$)')}))"
    return {
        "innerHTML assignment": assigned, "outerHTML assignment": assigned, "document.write call": m(t, r"\bdocument[.]write\s*\("),
        "dangerouslySetInnerHTML": m(t, r"\bdangerouslySetInnerHTML\s*[=:]"), "Response template": _template("xss"),
        "Response concatenation": f"({m(t, r'[.]send\s*\(.*<[a-zA-Z]')} AND {_added('xss')})",
    }[label]


def crypto(label: str) -> str:
    found = {"MD5": r"\bcreateHash\s*\(\s*[\"'](?i:md5)[\"']", "SHA1": r"\bcreateHash\s*\(\s*[\"'](?i:sha1)[\"']", "Math.random": r"\bMath[.]random\s*\("}
    return f"(language = 'python' OR {m('text', found[label])})" if label in found else "true"


def legacy() -> str:
    calls = r"\b(?:exec|execSync|spawn|spawnSync|readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream)\s*\(\s*"
    return f"(language = 'python' OR {m('text', calls + r'(?:`[^`]*\$\{|' + REQ + ')')} OR {m('text', r'\bpath[.](?:join|resolve)\s*\([^)]*' + REQ)})"


def ssrf_js() -> str:
    call = r"(?:^|[^\w$])(?:fetch|get|post|put|patch|delete|request)\s*\(\s*"
    inside = f"({m('text', r'\$\{\s*' + REQ + r'\s*\}')} OR list_has_any(live_ssrf, {_all(r'\$\{\s*([A-Za-z_$][\w$]*)\s*\}')}))"
    return _any([
        m("text", call + REQ + r"\s*[,)]"), f"list_has_any(live_ssrf, {_all(call + r'([A-Za-z_$][\w$]*)\s*[,)]')})", f"({m('text', call + '`')} AND {inside})",
    ])


def path_js() -> str:
    fs = (
        r"\b(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|open|openSync|access|accessSync|stat|statSync|unlink|unlinkSync"
        r"|rmdir|rmdirSync|mkdir|mkdirSync)\s*\(\s*"
    )
    first = f"len(list_filter({_all(fs + '([^,]*)')}, lambda a: contains(a, '+') AND ({m('a', REQ)} OR list_has_any(live_path, regexp_extract_all(a, '(\\w+)', 1))))) > 0"
    whole = "list_transform(string_split(a, ','), lambda x: trim(x))"
    joined = f"len(list_filter({_all(r'\bpath[.](?:join|resolve)\s*\(([^()]*)\)')}, lambda a: len(list_filter({whole}, lambda x: {m('x', '^' + REQ + '$')})) > 0 OR list_has_any(live_path, {whole}))) > 0"
    return _any([
        m("text", fs + REQ + r"\s*[,)]"), m("text", fs + r"`[^`]*\$\{"), first, f"list_has_any(live_path, {_all(fs + r'([A-Za-z_$][\w$]*)\s*[,)]')})", joined,
    ])


def command_js() -> str:
    call = r"\b(?:exec|execSync|execFile|execFileSync|spawn|spawnSync|fork)\s*\(\s*"
    listed = m("text", r"\b(?:execFile|execFileSync|spawn|spawnSync)\s*\([^,]*,\s*\[")
    added = f"len(list_filter({_all(call + '([^,]*)')}, lambda a: contains(a, '+') AND {m('a', REQ)})) > 0"
    return f"NOT {listed} AND " + _any([f"({m('text', call + '`')} AND {_template('cmd')})", m("text", call + REQ + r"\s*[,)]"), added])


#: Further tests of one detector each.
TESTS = {
    8: lambda: m("text", r"\balgorithms?\s*:\s*[\"']none[\"']"),
    11: lambda: m("text", r"[.](?:find|deleteMany|updateMany|aggregate)\w*\s*\(\s*" + REQ3 + r"\s*[,)]"),
    12: ssrf_js,
    14: lambda: _any([m("text", r"\borigin\s*:\s*(?:[\"'][*][\"']|true\b)"), m("text", r"(?:^|[^\w$.])cors\s*\(\s*\)"), m("text", r"[.]setHeader\s*\(\s*[\"']Access-Control-Allow-Origin[\"']\s*,\s*[\"'][*][\"']")]),
    17: lambda: m("text", r"\brejectUnauthorized\s*:\s*false\b|[.]NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*[\"']0[\"']"),
    21: path_js,
    22: command_js,
    23: lambda: f"{m('text', r'(?:^|[^\w$.])eval\s*\(')} AND NOT {m('text', r'\beval\s*\(\s*(?:true|false|null)\s*[,)]')}",
}
DEBUGGER = r"(?:^|[;{}])\s*debugger\s*(?:;|\}|$)"


def also(number: int, confirm: bool) -> str:
    """The test as a further condition, nothing in pattern mode."""
    return f" AND {TESTS[number]()}" if confirm else ""


__all__ = ["CATEGORIES", "DEBUGGER", "also", "cat", "crypto", "js_names", "legacy", "named_lines", "sql_js", "xss_js"]
