"""Patterns of the hand-written detectors 001-023.

Fixed values, in catalog order.  ``META`` holds severity defaults and texts;
the conditions that combine the patterns live in ``operators/detectors.py``.
"""

# ---- fixed values: rating and class of every detector ----
META = {
    # number: (name, severity, CWE, OWASP, advice)
    1: ("Hardcoded secret", "critical", "CWE-798", "A02:2021", "Read the value from the environment or a secret store."),
    2: ("SQL injection", "critical", "CWE-89", "A03:2021", "Bind parameters instead of building SQL text."),
    3: ("Cross-site scripting", "warning", "CWE-79", "A03:2021", "Escape or sanitize values before they become HTML."),
    4: ("Insecure cryptography", "warning", "CWE-327", "A02:2021", "Use a current hash, cipher or random source."),
    5: ("Unsafe file access or command", "critical", "CWE-78", "A03:2021", "Validate paths and never pass input to a shell."),
    6: ("Open redirect", "warning", "CWE-601", "A01:2021", "Redirect to known targets only."),
    7: ("Hardcoded JWT secret", "critical", "CWE-798", "A02:2021", "Read the signing key from a secret store."),
    8: ("JWT none algorithm", "critical", "CWE-327", "A02:2021", "Require a signing algorithm."),
    9: ("Function constructor", "critical", "CWE-95", "A03:2021", "Do not build functions from text."),
    10: ("Prototype pollution", "critical", "CWE-1321", "A03:2021", "Guard keys before copying objects."),
    11: ("NoSQL injection", "critical", "CWE-943", "A03:2021", "Build query objects from checked fields."),
    12: ("Server-side request forgery", "critical", "CWE-918", "A10:2021", "Request known hosts only."),
    13: ("Insecure cookie", "warning", "CWE-614", "A05:2021", "Set the httpOnly and secure flags."),
    14: ("CORS misconfiguration", "warning", "CWE-942", "A05:2021", "Allow named origins only."),
    15: ("Regular expression denial of service", "warning", "CWE-1333", "A06:2021", "Avoid nested quantifiers."),
    16: ("Information exposure", "warning", "CWE-209", "A04:2021", "Do not send error objects to clients."),
    17: ("Insecure TLS configuration", "critical", "CWE-295", "A07:2021", "Keep certificate checks on."),
    18: ("Timing attack", "warning", "CWE-208", "A02:2021", "Compare secrets in constant time."),
    19: ("Debugger statement", "info", "CWE-489", "A05:2021", "Remove the statement."),
    20: ("Unsafe deserialization", "critical", "CWE-502", "A08:2021", "Use a data-only format."),
    21: ("Path traversal", "critical", "CWE-22", "A01:2021", "Resolve the path and check its base."),
    22: ("Command injection", "critical", "CWE-78", "A03:2021", "Pass arguments as a list, without a shell."),
    23: ("Eval injection", "critical", "CWE-95", "A03:2021", "Parse data instead of evaluating it."),
}
#: order in which detectors report (005 is kept for old configurations and comes last)
ORDER = [n for n in range(1, 24) if n != 5] + [5]

# ---- contract of this engine for 001 and 007 (no published patterns) ----
SECRET_SHAPES = [
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"sk_live_[0-9a-zA-Z]{24,}",
    r"(?i)(?:api[_-]?key|secret[_-]?key|access[_-]?key|auth[_-]?token)\s*[:=]\s*[\"'`][A-Za-z0-9_/+=-]{16,}[\"'`]",
    r"(?i)(?:password|passwd|pwd)\s*[:=]\s*[\"'`][^\"'`\s]{8,}[\"'`]",
]
SECRET_ENV = r"process\.env|os\.environ|os\.getenv"
SECRET_PLACEHOLDER = r"[\"'`](?:test|example|placeholder|changeme|your|xxx)|xxxx"
JWT_LITERAL = r"jwt\.sign\s*\([^,]+,\s*[\"'`][^\"'`]+[\"'`]"

# ---- fixed values: patterns, in order of evaluation ----
SQL_WORDS = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b"
SQL_JS = [
    ("String concatenation",
     r"(?i)(?:query|execute|exec|raw)\s*\(\s*[\"'`](?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b[^\"'`]*[\"'`]\s*\+"),
    ("Template literal",
     r"(?i)(?:query|execute|exec|raw)\s*\(\s*`(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b[^`]*\$\{"),
]
SQL_PY_BOUND = r"\.execute\w*\s*\(\s*[\"'][^\"']*(?:%s|\?)[^\"']*[\"']\s*,"
SQL_PY_STATIC = r"\.execute\w*\s*\(\s*[\"'][^\"']*[\"']\s*\)"
SQL_PY_INLINE = [
    r"(?i)(?:execute|cursor\.execute|executemany)\s*\(\s*f[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b",
    r"(?i)(?:execute|cursor\.execute)\s*\(\s*[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b[^\"']*[\"']\.format\s*\(",
    r"(?i)(?:execute|cursor\.execute)\s*\(\s*[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b[^\"']*%s[^\"']*[\"']\s*%",
    r"(?i)(?:execute|cursor\.execute)\s*\(\s*[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b[^\"']*[\"']\s*\+",
]
SQL_PY_VARIABLE = r"\.execute\s*\(\s*(\w+)\s*[,)]"

XSS_JS = [
    ("innerHTML assignment", r"\.innerHTML\s*="),
    ("document.write call", r"document\.write\s*\("),
    ("outerHTML assignment", r"\.outerHTML\s*="),
    ("dangerouslySetInnerHTML", r"dangerouslySetInnerHTML"),
    ("Response template", r"res\.send\s*\(\s*`"),
    ("Response concatenation", r"res\.send\s*\(\s*[\"']<[^\"']*[\"']\s*\+"),
]
XSS_PY = [
    ("Response f-string", r"\b(?:make_response|Response)\s*\(\s*f[\"']<[^\"']*\{"),
    ("Returned f-string", r"\breturn\s+f[\"']<[^\"']*\{"),
    ("Returned format", r"\breturn\s+[\"']<[^\"']*[\"']\.format\s*\("),
    ("Returned % format", r"\breturn\s+[\"']<[^\"']*%s[^\"']*[\"']\s*%"),
    ("mark_safe f-string", r"\bmark_safe\s*\(\s*f[\"']"),
    ("mark_safe format", r"\bmark_safe\s*\(\s*[\"'][^\"']*[\"']\.format\s*\("),
]

CRYPTO = [
    ("MD5", r"(?i)(?:createHash\s*\(\s*[\"']md5[\"']|hashlib\.md5\s*\(|MD5\s*\(\s*[\"']md5[\"'])"),
    ("SHA1", r"(?i)(?:createHash\s*\(\s*[\"']sha1[\"']|hashlib\.sha1\s*\()"),
    ("Math.random", r"Math\.random\s*\(\s*\)"),
    ("Weak cipher", r"(?i)(?:createCipher(?:iv)?|DES|RC4)\s*\(\s*[\"'](?:des|rc4|des-ede)"),
]
CRYPTO_PASSWORD = r"password|passwd|secret|token|credential|auth"
CRYPTO_CHECKSUM = r"checksum|file|buffer|etag|cache|digest|fingerprint|integrity"

LEGACY = [
    ("Path from input", r"(?:readFile|writeFile|createReadStream|createWriteStream|open)\s*\(\s*(?:req\.|request\.|params\.|query\.|body\.)"),
    ("Joined path from input", r"path\.(?:join|resolve)\s*\([^)]*(?:req\.|request\.|params\.|query\.|body\.)"),
    ("open from input", r"open\s*\(\s*(?:request\.|f[\"']|input)"),
    ("exec or spawn from input", r"(?:exec|execSync|spawn|spawnSync)\s*\(\s*(?:req\.|request\.|params\.|query\.|body\.|`)"),
    ("Shell call from input", r"(?:os\.system|subprocess\.(?:call|run|Popen))\s*\(\s*(?:f[\"']|request\.|input)"),
]

REDIRECT = r"(?:res\.redirect|response\.redirect|window\.location|location\.href|location\.assign|location\.replace)\s*[\(=]\s*(?:req\.|request\.|params\.|query\.)"
JWT_NONE = r"(?i)algorithm[s]?\s*[:=]\s*[\"'`]none[\"'`]"
FUNCTION_CONSTRUCTOR = r"new\s+Function\s*\("
PROTOTYPE = r"__proto__|Object\.assign\s*\(|\.constructor\.prototype|for\s*\(.*\bin\b|_\.merge\s*\(|lodash\.merge\s*\(|merge\s*\(|deepmerge\s*\("
NOSQL = r"(?:find|findOne|findOneAndUpdate|findOneAndDelete|deleteMany|updateMany|aggregate)\s*\(\s*(?:req\.|request\.|body\.|query\.|\{[^}]*\$(?:where|gt|gte|lt|lte|ne|in|nin|regex|exists))"
SSRF_JS = r"(?:fetch|axios\.get|axios\.post|axios\(|http\.get|http\.request|https\.get|https\.request|got\(|request\()\s*\(\s*(?:req\.|request\.|query\.|params\.|body\.|`|\w)"
SSRF_PY = r"\b(?:requests\.(?:get|post|put|patch|delete|head|options|request)|urllib\.(?:request\.)?(?:urlopen|urlretrieve)|httpx\.(?:get|post|put|patch|delete|head|options|request))\s*\("
PY_PLAIN_LITERAL = r"\(\s*[\"'][^\"']*[\"']\s*[,)]"
COOKIE = r"(?:\.cookie\s*\(|cookie\s*[:=]|session\s*[:=]|Set-Cookie)"
CORS = r"(?:Access-Control-Allow-Origin|origin\s*[:=]\s*[\"'`]\*[\"'`]|cors\s*\(\s*\))"
REGEX_PRESENT = r"new\s+RegExp\s*\(|/[^/]+/[gimsuy]*"
REDOS = [
    r"\([^)]*[+*]\)[+*]",
    r"\([^)]*\|[^)]*\)[+*]{1,}",
    r"\(\([^)]*\)[+*]\)[+*]",
]
ERROR_EXPOSURE = r"(?:res\.(?:send|json|status)\s*\([^)]*(?:err|error|stack|message)|\.stack\b|console\.(?:log|error)\s*\([^)]*(?:err|error))"
TLS_OFF = r"rejectUnauthorized\s*[:=]\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*[:=]\s*[\"']0[\"']"
TIMING = r"(?i)(?:password|secret|token|hash|key|signature|apiKey|api_key)\s*(?:===|==|!==|!=)\s*"
DEBUGGER = r"^\s*debugger\s*;?\s*$"
DESERIALIZE = [
    ("Node unserialize", r"(?:serialize\.unserialize|unserialize)\s*\("),
    ("pickle", r"pickle\.(?:loads?|Unpickler)\s*\("),
    ("yaml.load", r"yaml\.load\s*\("),
    ("PHP unserialize", r"unserialize\s*\(\s*\$"),
    ("Java object stream", r"ObjectInputStream|readObject\s*\(\s*\)"),
]
PATH_JS = r"(?:readFile|writeFile|readFileSync|writeFileSync|createReadStream|createWriteStream|open|access|stat|unlink|rmdir|mkdir)\s*\(\s*(?:req\.|request\.|params\.|query\.|body\.|`|[\"'][^\"']*[\"']\s*\+)"
PATH_JOIN_JS = r"path\.(?:join|resolve)\s*\([^)]*(?:req\.|request\.|params\.|query\.|body\.)"
PATH_PY_OPEN = r"\bopen\s*\("
PATH_PY_LITERAL = r"\bopen\s*\(\s*[\"'][^\"']*[\"']\s*[,)]"
PATH_PY_DYNAMIC = r"\bopen\s*\(\s*(?:request\.|f[\"']|[\"'][^\"']*[\"']\s*\+)"
COMMAND_JS = r"(?:exec|execSync|spawn|spawnSync|execFile|execFileSync|fork)\s*\(\s*(?:req\.|request\.|params\.|query\.|body\.|`|[\"'][^\"']*[\"']\s*\+)"
COMMAND_PY = r"\b(?:os\.(?:system|popen)|subprocess\.(?:call|run|Popen|check_output|check_call))\s*\("
EVAL_JS = r"\beval\s*\(\s*[^\"'`\d)]"
EVAL_PY = r"\b(?:eval|exec)\s*\("
EVAL_PY_LITERAL = r"\b(?:eval|exec)\s*\(\s*[\"'][^\"']*[\"']\s*[,)]"

# ---- fixed values: quick triage catalog ----
QUICK = [
    ("SQL injection", "critical", "CWE-89", r"query\s*\(.*\+|query\s*\(\s*`[^`]*\$\{"),
    ("Command injection", "critical", "CWE-78", r"exec\s*\(.*req\.|exec\s*\(.*body"),
    ("Hardcoded secret", "critical", "CWE-798", r"sk_live_|sk_test_|ghp_|AKIA[A-Z0-9]"),
    ("Eval injection", "critical", "CWE-95", r"eval\s*\("),
    ("Cross-site scripting", "warning", "CWE-79", r"\.innerHTML\s*=|document\.write"),
    ("Cross-site scripting", "warning", "CWE-79", r"dangerouslySetInnerHTML"),
]
QUICK_TEMPLATE = r"query\s*\(\s*`[\s\S]*?\$\{[\s\S]*?`\s*\)"
