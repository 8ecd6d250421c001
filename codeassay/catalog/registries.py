"""Small lookup tables.

Fixed values: they decide which rows come out, so they are stated plainly.
"""

# ---- fixed values: languages by extension (batch scan knows all nine; the
# hosted tree filter knows the first seven listed in HOSTED_EXTENSIONS) ----
EXTENSION_LANGUAGE = {
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".py": "python",
}
HOSTED_EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".py")
IMPORT_EXTENSIONS_JS = ("js", "jsx", "mjs", "cjs", "ts", "tsx")

# ---- fixed values: ignored names of the batch scan ----
DEFAULT_IGNORE = (
    "node_modules", ".git", "dist", "build", ".next",
    "__pycache__", ".venv", "venv", "coverage",
)

# ---- fixed values: skipped path segments and limits of the hosted tree filter ----
TREE_SKIP_SEGMENTS = (
    "node_modules", "dist", "out", "target", "tmp", ".cache", ".next",
    "coverage", ".git", "vendor", "__pycache__", ".venv", "venv",
)
TREE_SIZE_CAP = 100_000
TREE_SIZE_CAP_PUBLIC = 1_000_000
TREE_FILE_CAP = 200
PACKAGE_CAP = 1500
SNIPPET_CHAR_CAP = 50_000

# ---- fixed values: dependency manifest names ----
MANIFEST_NAMES = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "requirements.txt", "Pipfile", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock",
)

# ---- fixed values: sanitizer registry, JavaScript/TypeScript ----
JS_SANITIZERS = (
    ("DOMPurify.sanitize", ("xss",)),
    ("sanitizeHtml", ("xss",)),
    ("xss", ("xss",)),
    ("escapeHtml", ("xss",)),
    ("escape", ("xss", "sql")),
    ("encodeURIComponent", ("xss", "ssrf")),
    ("encodeURI", ("ssrf",)),
    ("validator.escape", ("xss",)),
    ("validator.isEmail", ("universal",)),
    ("validator.isInt", ("sql", "cmd", "path")),
    ("validator.isNumeric", ("sql", "cmd", "path")),
    ("parseInt", ("cmd", "path", "ssrf")),
    ("parseFloat", ("cmd", "path", "ssrf")),
    ("Number", ("cmd", "path", "ssrf")),
    ("zod.parse", ("universal",)),
    ("Joi.validate", ("universal",)),
    ("mysql.escape", ("sql",)),
    ("sqlstring.escape", ("sql",)),
    ("shellEscape", ("cmd",)),
)

# ---- fixed values: sanitizer registry, Python ----
PY_SANITIZERS = (
    (("html.escape", "markupsafe.escape", "markupsafe.Markup", "bleach.clean", "escape"), ("xss",)),
    (("int", "float"), ("cmd", "path", "ssrf")),
    (("shlex.quote", "pipes.quote", "quote"), ("cmd",)),
    (("urllib.parse.quote", "urllib.parse.quote_plus"), ("ssrf",)),
    (("ast.literal_eval",), ("eval",)),
)
CATEGORIES = ("xss", "sql", "cmd", "path", "ssrf", "eval", "universal")

# ---- fixed values: partial mitigations of the path category ----
JS_PATH_MITIGATION = (
    r"\b(?:path\.basename|path\.normalize|path\.resolve|\.startsWith\s*\(|\.includes\s*\(\s*[\"']\.\.)"
)
PY_PATH_MITIGATION = (
    r"\b(?:os\.path\.basename|os\.path\.normpath|os\.path\.realpath|os\.path\.abspath|\.startswith\s*\()"
)

# ---- fixed values: numeric guard, user input sources ----
NUMERIC_GUARD = r"\b(?:isNaN|isFinite)\s*\("
PY_INPUT = r"\b(?:request\.\w+|input\s*\(|sys\.argv)"
PY_INPUT_WEB = r"\b(?:request\.\w+|input\s*\()"
JS_INPUT_MEMBERS = ("params", "query", "body", "headers")

# ---- fixed values: licence families ----
STRONG_COPYLEFT = (
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
    "AGPL-1.0", "AGPL-1.0-only", "AGPL-1.0-or-later",
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "SSPL-1.0", "EUPL-1.1", "EUPL-1.2",
)
WEAK_COPYLEFT = (
    "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MPL-2.0", "EPL-1.0", "EPL-2.0", "OSL-3.0", "CPAL-1.0",
)

# ---- fixed values: webhook targets, marker rows, quota limits ----
WEBHOOK_HOSTS = ("hooks.slack.com", "hooks.slack-gov.com")
WEBHOOK_HOSTS_WITH_PREFIX = ("discord.com", "discordapp.com")
WEBHOOK_PREFIX = "/api/webhooks/"
MARKER_RULES = ("SCA-META", "SCA-SKIPPED")
BURST_LIMIT, BURST_SECONDS = 5, 60
DAILY_LIMIT, DAILY_SECONDS = 30, 86_400
SLIDING_ANON, SLIDING_USER, SLIDING_SECONDS = 5, 20, 60
STUCK_MINUTES = 15


def js_sanitizer_names(category: str, with_universal: bool = True) -> list[str]:
    return [
        name
        for name, cats in JS_SANITIZERS
        if category in cats or (with_universal and "universal" in cats)
    ]


def py_sanitizer_names(category: str) -> list[str]:
    return [n for names, cats in PY_SANITIZERS if category in cats for n in names]
