"""Emission conditions.

An *emission* is one way a rule can report a line: a condition over the
candidate-line columns plus a list of outcomes (severity, confidence, text)
tried in order.  Plans number all outcomes; a line's findings are then an
array of small integers, and duplicate suppression is a minimum over them.

``mode="pattern"`` evaluates the line patterns alone.  ``mode="confirm"`` adds
structural tests on the argument text (the ``verification`` column tells them
apart).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from ..catalog import detectors as cat, registries as reg
from ..catalog.js_rules import js_rules
from ..catalog.model import ALL_LANGUAGES, JS_TS, Rule
from ..catalog.secrets import GATE_ASSIGN, GATE_ASSIGN_WORD, GATE_RUN, secret_rules
from ..functions.regex import alternation, spark_regex
from ..functions.text import rx
from .structure import any_call, called, in_open_loop, last_argument

REQ = r"(?:req|request)\.(?:params|query|body|headers)\b[\w.$]*"
REQ3 = r"(?:req|request)\.(?:params|query|body)\b[\w.$]*"
_MEMBERS = r"[\w$]*(?:\s*!?\s*\??\.\s*[\w$]+|\s*!?(?:\?\.)?\[(?:[^\[\]]|\[[^\[\]]*\])*\])*$"
#: An argument that is a member of the request and nothing else.
USER_ARG = r"^(?:req|request)\s*\??\.\s*(?:query|params|body|headers)" + _MEMBERS
USER_DATA_ARG = r"^(?:req|request)\s*\??\.\s*(?:query|params|body)" + _MEMBERS
#: A literal: text, number, true, false, null, regular expression.
LITERAL_ARG = r"""^(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[\d.][\w.]*|true|false|null|/.*/[a-z]*)$"""
#: Detectors that look at calls and loops when they confirm.
STRUCTURAL = frozenset((6, 9, 10, 13, 16))


@dataclass(frozen=True)
class Outcome:
    severity: str
    confidence: str
    message: str
    when: Column | None = None


@dataclass(frozen=True)
class Emission:
    rule_id: str
    name: str
    cwe: str
    owasp: str
    suggestion: str
    languages: tuple
    condition: Column
    outcomes: list = field(default_factory=list)
    #: pattern whose first match gives the column; None = column 1
    column_pattern: str | None = None
    secret: bool = False
    family: str | None = None
    confirmed: bool = False


def _text() -> Column:
    return F.col("text")


def _is_py() -> Column:
    return F.col("language") == "python"


def _next_three() -> Column:
    return F.array_join(F.slice("after", 1, 4), " ")


def _names(kind: str) -> Column:
    return F.transform(F.filter("tags", lambda t: t["k"] == kind), lambda t: t["v"])


def _has(kind: str) -> Column:
    return F.exists("tags", lambda t: t["k"] == kind)


def _live(sanitized: str) -> Column:
    """Tainted names on the line that were not sanitized for the category."""
    return F.array_except(_names("src"), _names(sanitized))


def _window(n_before: int, n_after: int) -> Column:
    """Lines i-n_before .. i+n_after as one array."""
    before = F.when(
        F.size("before") > n_before, F.slice("before", F.size("before") - n_before + 1, F.lit(n_before))
    ).otherwise(F.col("before"))
    return F.concat(before, F.slice("after", 1, n_after + 1))


def sanitizer_nearby(category: str) -> Column:
    """A sanitizer of the category (or a universal one) on lines i-5 .. i+2."""
    pattern = spark_regex(alternation(reg.js_sanitizer_names(category)))
    test = lambda x: x.rlike(pattern)
    if category == "path":
        mitigation = spark_regex(reg.JS_PATH_MITIGATION)
        test = lambda x: x.rlike(pattern) | x.rlike(mitigation)
    return F.exists(_window(5, 2), test)


def _extract(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_text(), F.lit(spark_regex(pattern)), F.lit(group))


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _template_unsafe(category: str) -> Column:
    """Some interpolated value is neither a sanitizer call nor a sanitized name."""
    call = r"^\s*(?:" + "|".join(n.replace(".", r"\.") for n in reg.js_sanitizer_names(category)) + r")\s*\("
    safe_names = _names(f"san-{category}")
    values = _extract(r"\$\{([^}]*)\}")
    return (F.size(values) > 0) & F.exists(
        values, lambda v: ~v.rlike(call) & ~F.array_contains(safe_names, F.trim(v))
    )


def _added_unsafe(category: str) -> Column:
    """Some ``+ value`` is neither a literal, a sanitizer call nor a sanitized name."""
    call = r"^(?:" + "|".join(n.replace(".", r"\.") for n in reg.js_sanitizer_names(category)) + r")\s*\("
    safe_names = _names(f"san-{category}")
    values = _extract(r"\+\s*([A-Za-z_$][\w$.]*\s*\(?)")
    return F.exists(
        values, lambda v: ~v.rlike(call) & ~F.array_contains(safe_names, F.trim(v))
    )


#: literals of which a line must contain at least one, by detector and language
#: group; implied by the patterns, and much cheaper than they are.  Those of
#: CASELESS are held against the lower-cased line, as their patterns ignore case
ANCHORS = {
    (2, "js"): ("query", "exec", "raw"),
    (2, "py"): ("execute",),
    (3, "js"): (".innerHTML", "document.write", ".outerHTML", "dangerouslySetInnerHTML", "res.send"),
    (3, "py"): ("return", "make_response", "Response", "mark_safe"),
    (5, "all"): ("File", "Stream", "open", "path.", "exec", "spawn", "os.system", "subprocess."),
    (6, "js"): ("redirect", "location"),
    (7, "js"): ("jwt.sign",),
    (9, "js"): ("Function",),
    (10, "js"): ("__proto__", "Object.assign", ".prototype", "for", "merge"),
    (11, "js"): ("find", "deleteMany", "updateMany", "aggregate"),
    (12, "js"): ("fetch", "axios", "http", "got(", "request("),
    (12, "py"): ("requests.", "urllib.", "httpx."),
    (13, "js"): (".cookie",),
    (14, "js"): ("Access-Control", "origin", "cors"),
    (15, "all"): (")+", ")*"),
    (16, "js"): (".send", ".json"),
    (17, "js"): ("rejectUnauthorized", "NODE_TLS_REJECT"),
    (18, "js"): ("==", "!="),
    (19, "js"): ("debugger",),
    (20, "all"): ("unserialize", "pickle.", "yaml.load", "ObjectInputStream", "readObject"),
    (21, "js"): ("File", "Stream", "open", "access", "stat", "unlink", "dir", "path."),
    (21, "py"): ("open",),
    (22, "js"): ("exec", "spawn", "fork"),
    (22, "py"): ("os.", "subprocess."),
    (23, "js"): ("eval",),
    (23, "py"): ("eval", "exec"),
}
CASELESS = {(2, "js"), (2, "py")}


def _make(no, languages, condition, outcomes, *, column=None, confirmed=False, anchored=True):
    name, _, cwe, owasp, advice = cat.META[no]
    group = "all" if len(languages) == 3 else ("py" if languages == ("python",) else "js")
    literals = ANCHORS.get((no, group)) if anchored else None
    if literals:
        line = F.lower(_text()) if (no, group) in CASELESS else _text()
        condition = _any([line.contains(a) for a in literals]) & condition
    return Emission(
        rule_id=f"SG-{no:03d}", name=name, cwe=cwe, owasp=owasp, suggestion=advice,
        languages=languages, condition=condition, outcomes=outcomes, column_pattern=column, confirmed=confirmed,
    )


def _nearby(category: str, severity: str, message: str):
    return [
        Outcome(severity, "medium", message, sanitizer_nearby(category)),
        Outcome(severity, "high", message),
    ]


def _one(no: int, message: str | None = None, confidence: str = "high"):
    return [Outcome(cat.META[no][1], confidence, message or cat.META[no][0])]


# ------------------------------------------------------------------ detectors
def _secrets_001(c):
    tokens = _any([_text().contains(a) for a in ("AKIA", "gh", "sk_live_")]) & _any([rx(_text(), p) for p in cat.SECRET_SHAPES[:3]])
    assigned = _text().rlike(GATE_ASSIGN) & _any([rx(_text(), p) for p in cat.SECRET_SHAPES[3:]])
    hit = tokens | assigned
    return [_make(1, ALL_LANGUAGES, hit & ~_text().rlike(cat.SECRET_ENV) & ~_text().rlike(cat.SECRET_PLACEHOLDER), _one(1))]


def _sql_002(c):
    guard = F.array_join(_window(5, 1), " ")
    outs = lambda label: [
        Outcome("critical", "medium", f"SQL injection: {label}", rx(guard, reg.NUMERIC_GUARD)),
        Outcome("critical", "high", f"SQL injection: {label}"),
    ]
    found = []
    for label, pattern in cat.SQL_JS:
        cond = rx(_text(), pattern)
        if c:
            check = _added_unsafe("sql") if label.startswith("String") else _template_unsafe("sql")
            cond = cond & check
        found.append(_make(2, JS_TS, cond, outs(label), confirmed=c))
    if c:
        per_line = _any([e.condition for e in found])
        found.append(
            _make(2, JS_TS, F.col("template_start") & ~per_line,
                  [Outcome("critical", "high", "SQL injection: template over several lines")], confirmed=True, anchored=False)
        )
    skip = rx(_text(), cat.SQL_PY_BOUND) | (rx(_text(), cat.SQL_PY_STATIC) & ~_text().contains("%s"))
    inline = _any([rx(_text(), p) for p in cat.SQL_PY_INLINE])
    variable = F.exists(
        F.slice(_extract(cat.SQL_PY_VARIABLE), 1, 1), lambda v: F.array_contains(_names("sqlvar"), v)
    )
    strong = Outcome("critical", "high", "SQL injection: query text from user data")
    found.append(
        _make(2, ("python",), ~skip & inline, [
            Outcome(strong.severity, strong.confidence, strong.message, rx(_text(), reg.PY_INPUT)),
            Outcome("critical", "medium", "SQL injection: dynamic query text"),
        ])
    )
    found.append(_make(2, ("python",), ~skip & ~inline & variable, [strong]))
    return found


def _xss_003(c):
    literal_rhs = r"\.(?:inner|outer)HTML\s*=\s*(?:\"[^\"]*\"|'[^']*'|\d+|true|false|null)\s*(?:[;,)}]|$)"
    safe_call_rhs = (
        r"\.(?:inner|outer)HTML\s*=\s*(?:" + "|".join(n.replace(".", r"\.") for n in reg.js_sanitizer_names("xss")) + r")\s*\("
    )
    rhs_name = _extract(r"\.(?:inner|outer)HTML\s*=\s*([A-Za-z_$][\w$]*)\s*(?:[;,)}]|$)")
    confirm = {
        "innerHTML assignment": ~rx(_text(), literal_rhs) & ~rx(_text(), safe_call_rhs)
        & ~F.exists(rhs_name, lambda v: F.array_contains(_names("san-xss"), v)),
        "document.write call": rx(_text(), r"\bdocument\.write\s*\("),
        "dangerouslySetInnerHTML": rx(_text(), r"\bdangerouslySetInnerHTML\s*[=:]"),
        "Response template": _template_unsafe("xss"),
        "Response concatenation": rx(_text(), r"\.send\s*\(.*<[a-zA-Z]") & _added_unsafe("xss"),
    }
    confirm["outerHTML assignment"] = confirm["innerHTML assignment"]
    found = []
    literal = dict(zip((label for label, _ in cat.XSS_JS), (".innerHTML", "document.write", ".outerHTML", "dangerouslySetInnerHTML", "res.send", "res.send")))
    for label, pattern in cat.XSS_JS:
        cond = _text().contains(literal[label]) & rx(_text(), pattern)
        if c:
            cond = cond & confirm[label]
        found.append(_make(3, JS_TS, cond, _nearby("xss", "warning", f"XSS: {label}"), confirmed=c))
    web = rx(_text(), reg.PY_INPUT_WEB)
    earlier = None
    for label, pattern in cat.XSS_PY:
        hit = rx(_text(), pattern)
        cond = hit & ~(_has("san-xss") & ~web)
        if earlier is not None:
            cond = cond & ~earlier
        earlier = hit if earlier is None else earlier | hit
        found.append(
            _make(3, ("python",), cond, [
                Outcome("critical", "high", f"XSS: {label}", web), Outcome("critical", "medium", f"XSS: {label}"),
            ])
        )
    return found


def _crypto_004(c):
    around = F.lower(F.array_join(_window(3, 3), " "))
    checksum = around.rlike(cat.CRYPTO_CHECKSUM) & ~around.rlike(cat.CRYPTO_PASSWORD)
    confirm = {
        "MD5": rx(_text(), r"\bcreateHash\s*\(\s*[\"'](?i:md5)[\"']"),
        "SHA1": rx(_text(), r"\bcreateHash\s*\(\s*[\"'](?i:sha1)[\"']"),
        "Math.random": rx(_text(), r"\bMath\.random\s*\("),
    }
    found = []
    low = F.lower(_text())
    literal = {
        "MD5": low.contains("md5"), "SHA1": low.contains("sha1"), "Math.random": _text().contains("Math.random"),
        "Weak cipher": low.contains("des") | low.contains("rc4"),
    }
    for label, pattern in cat.CRYPTO:
        cond = literal[label] & rx(_text(), pattern)
        if c and label in confirm:
            cond = cond & (_is_py() | confirm[label])
        outs = [Outcome("warning", "high", f"Weak cryptography: {label}")]
        if label in ("MD5", "SHA1"):
            outs.insert(0, Outcome("warning", "medium", f"Weak cryptography: {label}", checksum))
        found.append(_make(4, ALL_LANGUAGES, cond, outs, confirmed=c))
    return found


def _legacy_005(c):
    unsafe = (
        rx(_text(), r"\b(?:exec|execSync|spawn|spawnSync|readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream)"
                 rf"\s*\(\s*(?:`[^`]*\$\{{|{REQ})")
        | rx(_text(), rf"\bpath\.(?:join|resolve)\s*\([^)]*{REQ}")
    )
    return [
        _make(5, ALL_LANGUAGES, rx(_text(), p) & ((_is_py() | unsafe) if c else F.lit(True)), _one(5, f"Unsafe access: {label}"), confirmed=c)
        for label, p in cat.LEGACY
    ]


def _redirect_006(c):
    cond = rx(_text(), cat.REDIRECT)
    if c:
        sent = any_call(lambda x: x["member"] & called(x, "redirect", "assign", "replace") & F.coalesce(last_argument(x).rlike(USER_ARG), F.lit(False)))
        cond = cond & (sent | rx(_text(), rf"\.href\s*=\s*{REQ}\s*(?:[;,)}}]|$)"))
    return [_make(6, JS_TS, cond, _one(6), confirmed=c)]


def _jwt_007(c):
    return [_make(7, JS_TS, _text().contains("jwt.sign") & rx(_text(), cat.JWT_LITERAL), _one(7))]


def _jwt_none_008(c):
    cond = F.lower(_text()).contains("algorithm") & rx(_text(), cat.JWT_NONE)
    if c:
        cond = cond & rx(_text(), r"\balgorithms?\s*:\s*[\"']none[\"']")
    return [_make(8, JS_TS, cond, _one(8), confirmed=c)]


def _function_009(c):
    cond = rx(_text(), cat.FUNCTION_CONSTRUCTOR)
    if c:
        cond = cond & any_call(lambda x: x["made"] & (x["name"] == "Function") & F.coalesce(~last_argument(x).rlike(LITERAL_ARG), F.lit(False)))
    return [_make(9, JS_TS, cond, _one(9), confirmed=c)]


def _prototype_010(c):
    cond = rx(_text(), cat.PROTOTYPE)
    if c:
        cond = cond & (
            in_open_loop()
            | rx(_text(), r"\.__proto__\b")
            | any_call(lambda x: (x["name"] == "Object.assign") & F.exists(x["args"], lambda a: a.rlike(USER_DATA_ARG)))
            | rx(_text(), r"\.constructor\.prototype\b")
            | any_call(lambda x: ~x["made"] & x["name"].isin("_.merge", "_.defaultsDeep", "lodash.merge", "merge", "deepmerge"))
        )
    return [_make(10, JS_TS, cond, _one(10), confirmed=c)]


def _nosql_011(c):
    cond = rx(_text(), cat.NOSQL)
    if c:
        cond = cond & rx(_text(), rf"\.(?:find|deleteMany|updateMany|aggregate)\w*\s*\(\s*{REQ3}\s*[,)]")
    return [_make(11, JS_TS, cond, _one(11), confirmed=c)]


def _ssrf_012(c):
    cond = rx(_text(), cat.SSRF_JS)
    if c:
        call = r"(?:^|[^\w$])(?:fetch|get|post|put|patch|delete|request)\s*\(\s*"
        live = _live("san-ssrf")
        cond = cond & (
            rx(_text(), rf"{call}{REQ}\s*[,)]")
            | F.arrays_overlap(live, _extract(call + r"([A-Za-z_$][\w$]*)\s*[,)]"))
            | (
                rx(_text(), call + "`")
                & (rx(_text(), rf"\$\{{\s*{REQ}\s*\}}") | F.arrays_overlap(live, _extract(r"\$\{\s*([A-Za-z_$][\w$]*)\s*\}")))
            )
        )
    found = [_make(12, JS_TS, cond, _nearby("ssrf", "critical", "SSRF: request to a user-controlled address"), confirmed=c)]
    tainted = rx(_text(), reg.PY_INPUT) | (F.size(_live("san-ssrf")) > 0)
    found.append(
        _make(12, ("python",), rx(_text(), cat.SSRF_PY) & ~rx(_text(), cat.PY_PLAIN_LITERAL), [
            Outcome("critical", "high", "SSRF: user data in a request address", tainted),
            Outcome("critical", "medium", "SSRF: dynamic request address"),
        ])
    )
    return found


def _cookie_013(c):
    if not c:
        return []
    flagged = lambda x: F.array_contains(x["options"], "httpOnly:true") & F.array_contains(x["options"], "secure:true")
    unsafe = any_call(lambda x: x["member"] & ~x["made"] & called(x, "cookie") & ((F.size(x["args"]) == 2) | ((F.size(x["args"]) > 2) & ~flagged(x))))
    cond = rx(_text(), cat.COOKIE) & unsafe
    return [_make(13, JS_TS, cond, _one(13), confirmed=True)]


def _cors_014(c):
    cond = rx(_text(), cat.CORS)
    if c:
        cond = cond & (
            rx(_text(), r"\borigin\s*:\s*(?:[\"']\*[\"']|true\b)")
            | rx(_text(), r"(?:^|[^\w$.])cors\s*\(\s*\)")
            | rx(_text(), r"\.setHeader\s*\(\s*[\"']Access-Control-Allow-Origin[\"']\s*,\s*[\"']\*[\"']")
        )
    return [_make(14, JS_TS, cond, _one(14), confirmed=c)]


def _redos_015(c):
    return [_make(15, ALL_LANGUAGES, rx(_text(), cat.REGEX_PRESENT) & _any([rx(_text(), p) for p in cat.REDOS]), _one(15))]


def _exposure_016(c):
    if not c:
        return []
    error = r"^(?i:err|error|e)(?:\s*\.\s*(?:stack|message))?$"
    cond = rx(_text(), cat.ERROR_EXPOSURE) & any_call(lambda x: x["member"] & ~x["made"] & called(x, "send", "json") & F.exists(x["values"], lambda v: v.rlike(error)))
    return [_make(16, JS_TS, cond, _one(16), confirmed=True)]


def _tls_017(c):
    cond = rx(_text(), cat.TLS_OFF)
    if c:
        cond = cond & rx(_text(), r"\brejectUnauthorized\s*:\s*false\b|\.NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*[\"']0[\"']")
    return [_make(17, JS_TS, cond, _one(17), confirmed=c)]


def _timing_018(c):
    if not c:
        return []
    names = r"(?:password|secret|token|hash|key|signature|apikey|api_key|digest|hmac)"
    cond = rx(_text(), cat.TIMING) & (
        rx(_text(), rf"(?i)(?:^|[^\w$]){names}\s*(?:===|!==|==|!=)")
        | rx(_text(), rf"(?i)(?:===|!==|==|!=)\s*(?:[\w$]+\.)*{names}\s*(?:[^\w$.(\[\s]|$)")
    )
    return [_make(18, JS_TS, cond, _one(18), confirmed=True)]


def _debugger_019(c):
    if c:
        pattern = r"(?:^|[;{}])\s*debugger\s*(?:;|\}|$)"
        return [_make(19, JS_TS, rx(_text(), pattern), _one(19), column="debugger", confirmed=True)]
    return [_make(19, JS_TS, rx(_text(), cat.DEBUGGER), _one(19))]


def _deserialize_020(c):
    return [_make(20, ALL_LANGUAGES, rx(_text(), p), _one(20, f"Unsafe deserialization: {label}")) for label, p in cat.DESERIALIZE]


def _path_021(c):
    cond = rx(_text(), cat.PATH_JS) | rx(_text(), cat.PATH_JOIN_JS)
    if c:
        fs = (
            r"\b(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|open|openSync|access|accessSync"
            r"|stat|statSync|unlink|unlinkSync|rmdir|rmdirSync|mkdir|mkdirSync)\s*\(\s*"
        )
        live = _live("san-path")
        first_arg = _extract(fs + r"([^,]*)")
        joined = _extract(r"\bpath\.(?:join|resolve)\s*\(([^()]*)\)")
        whole = lambda a: F.transform(F.split(a, ","), lambda x: F.trim(x))
        cond = cond & (
            rx(_text(), rf"{fs}{REQ}\s*[,)]")
            | rx(_text(), fs + r"`[^`]*\$\{")
            | F.exists(
                first_arg,
                lambda a: a.contains("+")
                & (rx(a, REQ) | F.arrays_overlap(live, F.regexp_extract_all(a, F.lit(r"(\w+)"), F.lit(1)))),
            )
            | F.arrays_overlap(live, _extract(fs + r"([A-Za-z_$][\w$]*)\s*[,)]"))
            | F.exists(
                joined,
                lambda a: F.exists(whole(a), lambda x: x.rlike("^" + REQ.replace(r"\b", "") + "$"))
                | F.arrays_overlap(live, whole(a)),
            )
        )
    found = [_make(21, JS_TS, cond, _nearby("path", "critical", "Path traversal: user data in a file path"), confirmed=c)]
    source = rx(_text(), reg.PY_INPUT)
    tainted = source | rx(_text(), cat.PATH_PY_DYNAMIC) | (F.size(_live("san-path")) > 0)
    found.append(
        _make(21, ("python",), rx(_text(), cat.PATH_PY_OPEN) & ~rx(_text(), cat.PATH_PY_LITERAL) & tainted, [
            Outcome("critical", "high", "Path traversal: user data in open()", source),
            Outcome("critical", "medium", "Path traversal: user data in open()"),
        ])
    )
    return found


def _command_022(c):
    cond = rx(_text(), cat.COMMAND_JS)
    if c:
        call = r"\b(?:exec|execSync|execFile|execFileSync|spawn|spawnSync|fork)\s*\(\s*"
        listed = rx(_text(), r"\b(?:execFile|execFileSync|spawn|spawnSync)\s*\([^,]*,\s*\[")
        first_arg = _extract(call + r"([^,]*)")
        cond = cond & ~listed & (
            (rx(_text(), call + "`") & _template_unsafe("cmd"))
            | rx(_text(), rf"{call}{REQ}\s*[,)]")
            | F.exists(first_arg, lambda a: a.contains("+") & rx(a, REQ))
        )
    found = [_make(22, JS_TS, cond, _nearby("cmd", "critical", "Command injection: user data in a command"), confirmed=c)]
    live = _live("quoted")
    quoted = _names("quoted")
    opened = _extract(r"\(\s*(\w+)\b")
    safe = (
        rx(_text(), r"\(\s*\[")
        | rx(_text(), cat.PY_PLAIN_LITERAL)
        | F.arrays_overlap(quoted, opened)
        | ((F.size(quoted) > 0) & (F.size(live) == 0))
    )
    tainted = rx(_text(), reg.PY_INPUT) | (F.size(live) > 0)
    found.append(
        _make(22, ("python",), rx(_text(), cat.COMMAND_PY) & ~safe, [
            Outcome("critical", "high", "Command injection: user data in a shell command", tainted),
            Outcome("warning", "medium", "Command injection: dynamic value in a shell command"),
        ])
    )
    return found


def _eval_023(c):
    cond = rx(_text(), cat.EVAL_JS)
    if c:
        cond = cond & rx(_text(), r"(?:^|[^\w$.])eval\s*\(") & ~rx(_text(), r"\beval\s*\(\s*(?:true|false|null)\s*[,)]")
    found = [_make(23, JS_TS, cond, _one(23), confirmed=c)]
    found.append(
        _make(23, ("python",), rx(_text(), cat.EVAL_PY) & ~rx(_text(), cat.EVAL_PY_LITERAL), [
            Outcome("critical", "high", "Eval injection: user data evaluated", rx(_text(), reg.PY_INPUT)),
            Outcome("critical", "medium", "Eval injection: dynamic text evaluated"),
        ])
    )
    return found


_BUILDERS = {
    1: _secrets_001, 2: _sql_002, 3: _xss_003, 4: _crypto_004, 5: _legacy_005, 6: _redirect_006, 7: _jwt_007,
    8: _jwt_none_008, 9: _function_009, 10: _prototype_010, 11: _nosql_011, 12: _ssrf_012, 13: _cookie_013,
    14: _cors_014, 15: _redos_015, 16: _exposure_016, 17: _tls_017, 18: _timing_018, 19: _debugger_019,
    20: _deserialize_020, 21: _path_021, 22: _command_022, 23: _eval_023,
}


def detector_emissions(mode: str = "pattern", numbers=None) -> list[Emission]:
    wanted = set(numbers if numbers is not None else cat.ORDER)
    return [e for n in cat.ORDER if n in wanted for e in _BUILDERS[n](mode == "confirm")]


# ---------------------------------------------------------- declarative rules
def rule_condition(rule: Rule) -> Column:
    cond = rx(_text(), rule.pattern)
    if rule.anchors:
        source = F.lower(_text()) if rule.anchors_lower else _text()
        cond = _any([source.contains(a) for a in rule.anchors]) & cond
    if rule.anti_scope == "file":
        return F.coalesce(F.col("file_rule_line"), F.lit(False))
    if rule.skip_comments:
        cond = cond & ~_text().rlike(r"^\s*(?://|\*)")
    if rule.anti_scope == "window":
        cond = cond & ~rx(_next_three(), rule.anti_pattern)
    return cond


def rule_emission(rule: Rule) -> Emission:
    return Emission(
        rule_id=rule.rule_id, name=rule.name, cwe=rule.cwe, owasp=rule.owasp, suggestion=rule.suggestion,
        languages=rule.languages, condition=rule_condition(rule),
        outcomes=[Outcome(rule.severity, rule.confidence, rule.message)],
        column_pattern=rule.pattern, secret=rule.kind == "secret", family=rule.gate,
    )


def js_emissions() -> list[Emission]:
    return [rule_emission(r) for r in js_rules()]


def secret_emissions() -> list[Emission]:
    return [rule_emission(r) for r in secret_rules()]


def family_gate(family: str | None) -> Column:
    """Cheap test implied by every pattern of a secret family."""
    return {
        "assign": _text().rlike(GATE_ASSIGN) & _text().rlike(GATE_ASSIGN_WORD),
        "run": _text().rlike(GATE_RUN),
        "uri": _text().contains("://"),
        "pem": _text().contains("-----BEGIN"),
        "header": _text().contains("uthorization"),
        "service": _text().contains("service_account"),
        "account": _text().contains("AccountKey="),
        "sig": _text().contains("sig="),
        "define": _text().contains("define("),
    }[family]
