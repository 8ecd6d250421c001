"""Declarative JavaScript/TypeScript rules 030-069.

Each row: number, name, severity, confidence, CWE, OWASP, advice, pattern,
suppressor, anchors.  Patterns, suppressors and ratings are fixed values;
anchors are literals that the pattern cannot match without (an anchor tuple
starting with ``"i"`` is compared in lower case).
"""

from __future__ import annotations

from .model import JS_TS, Rule

# ---- fixed values ----
_ROWS = [
    # React
    (30, "Script URI in href", "critical", "high", "CWE-79", "A03:2021",
     "Use a click handler instead of a script URI.",
     r"(?i)href\s*=\s*[{(]?\s*[\"'`]javascript:", None, ("i", "javascript:")),
    (31, "Blank target without rel", "warning", "medium", "CWE-1022", "A05:2021",
     "Add rel=noopener to links that open a new tab.",
     r"target\s*=\s*[\"']_blank[\"']", r"rel\s*=\s*[\"'][^\"']*noopener", ("_blank",)),
    (32, "Unsafe lifecycle method", "warning", "medium", "CWE-477", "A06:2021",
     "Move to the supported lifecycle hooks.",
     r"UNSAFE_(?:componentWillMount|componentWillReceiveProps|componentWillUpdate)\s*\(", None, ("UNSAFE_",)),
    (33, "Effect without cleanup", "info", "low", "CWE-404", "A06:2021",
     "Return a cleanup function from the effect.",
     r"useEffect\s*\(\s*(?:async\s*)?\(\s*\)\s*=>\s*\{[^}]*(?:setInterval|addEventListener|subscribe|WebSocket)\b",
     r"return\s", ("useEffect",)),
    # Next.js
    (34, "Secret in public variable", "critical", "high", "CWE-200", "A01:2021",
     "Keep secrets out of variables that reach the browser.",
     r"(?i)NEXT_PUBLIC_(?:SECRET|PASSWORD|TOKEN|PRIVATE|API_SECRET|DB_|DATABASE|SUPABASE_SERVICE)", None,
     ("i", "next_public_")),
    (35, "Route handler without auth check", "warning", "medium", "CWE-306", "A07:2021",
     "Check the caller at the start of the handler.",
     r"export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)\s*\(",
     r"(?i)auth|session|getUser|getToken|verify|middleware|unauthorized|401", ("export",)),
    (36, "Unchecked redirect", "warning", "medium", "CWE-601", "A01:2021",
     "Check the target against a list of allowed addresses.",
     r"(?:redirect|NextResponse\.redirect)\s*\(\s*(?:req\.|request\.|params\.|query\.|searchParams)", None, ("redirect",)),
    (37, "Server action exposes secrets", "warning", "medium", "CWE-200", "A01:2021",
     "Strip sensitive fields before data leaves the server.",
     r"(?i)['\"]use server['\"][\s\S]{0,500}(?:password|secret|token|apiKey|private_key)\s*[,:]", None, ("i", "use server")),
    # Node.js
    (38, "Buffer constructor", "warning", "medium", "CWE-131", "A06:2021",
     "Use Buffer.alloc or Buffer.from.", r"new\s+Buffer\s*\(", None, ("Buffer",)),
    (39, "Plain HTTP server", "warning", "medium", "CWE-319", "A02:2021",
     "Serve over TLS or behind a terminating proxy.",
     r"http\.createServer\s*\(", r"(?i)https|proxy|localhost|127\.0\.0\.1|test", ("createServer",)),
    (40, "World-writable file mode", "critical", "high", "CWE-732", "A01:2021",
     "Use an owner-only mode.",
     r"(?:chmod|chmodSync|writeFile|writeFileSync)\s*\([^)]*(?:0o?777|0o?766|0o?776)", None, ("chmod", "writeFile")),
    (41, "Regex from input", "critical", "high", "CWE-1333", "A03:2021",
     "Escape input before building a regular expression.",
     r"new\s+RegExp\s*\(\s*(?:req\.|request\.|params\.|query\.|body\.|input|user)", None, ("RegExp",)),
    (42, "Child process with shell", "critical", "high", "CWE-78", "A03:2021",
     "Run the program without a shell.",
     r"(?:spawn|execFile)\s*\([^)]*\{[^}]*shell\s*:\s*true", None, ("shell",)),
    (43, "Empty rejection handler", "warning", "medium", "CWE-755", "A09:2021",
     "Handle the rejection.", r"\.catch\s*\(\s*\)", None, (".catch",)),
    # Express
    (44, "No security headers", "warning", "medium", "CWE-693", "A05:2021",
     "Install a security header middleware.",
     r"app\.(?:use|get|post|put|delete|listen)\s*\(", r"helmet", ("app.",)),
    (45, "Body parser without limit", "warning", "medium", "CWE-400", "A05:2021",
     "Give the body parser a size limit.",
     r"(?:express\.json|express\.urlencoded|bodyParser\.json|bodyParser\.urlencoded)\s*\(\s*\)", None,
     ("express.", "bodyParser.")),
    (46, "Static files with dotfiles", "warning", "medium", "CWE-538", "A01:2021",
     "Deny dotfiles when serving static files.",
     r"express\.static\s*\(\s*[\"'`][^\"'`]+[\"'`]\s*\)", r"dotfiles", ("express.static",)),
    (47, "Session without secure cookie", "critical", "high", "CWE-614", "A02:2021",
     "Set the secure and httpOnly cookie options.",
     r"session\s*\(\s*\{[\s\S]{0,200}secret\s*:", r"secure\s*:\s*true", ("session",)),
    (48, "Stack trace in response", "warning", "medium", "CWE-209", "A04:2021",
     "Answer with a generic error message.",
     r"(?:res\.(?:json|send|status))\s*\([^)]*(?:err\.stack|error\.stack|\.stack)", None, (".stack",)),
    # DOM and browser
    (49, "Message event without origin check", "critical", "high", "CWE-346", "A07:2021",
     "Check the origin of the event first.",
     r"addEventListener\s*\(\s*[\"']message[\"']", r"(?:event|e|msg)\.origin", ("addEventListener",)),
    (50, "Sensitive data in localStorage", "warning", "medium", "CWE-922", "A04:2021",
     "Keep tokens in http-only cookies.",
     r"(?i)localStorage\.setItem\s*\(\s*[\"'`](?:token|auth|jwt|session|password|secret|api[_-]?key)", None,
     ("i", "localstorage")),
    (51, "Window opened with opener", "warning", "medium", "CWE-1022", "A05:2021",
     "Pass noopener in the window features.",
     r"window\.open\s*\(\s*[^,)]+\s*(?:\)|,\s*[\"'][^\"']*[\"']\s*\))", r"noopener", ("window.open",)),
    (52, "document.domain assignment", "critical", "high", "CWE-346", "A07:2021",
     "Use messages between windows instead.", r"document\.domain\s*=", None, ("document.domain",)),
    (53, "Location from input", "critical", "high", "CWE-79", "A03:2021",
     "Allow only http and https targets.",
     r"(?:location\.href|window\.location|location\.assign|location\.replace)\s*=\s*(?:req\.|request\.|params\.|query\.|input|user)",
     None, ("location",)),
    # Authentication
    (54, "Weak password length", "warning", "medium", "CWE-521", "A07:2021",
     "Require longer passwords.", r"(?i)password.*\.length\s*(?:>=?|>)\s*[1-5]\b", None, ("i", ".length")),
    (55, "Form without CSRF token", "warning", "medium", "CWE-352", "A01:2021",
     "Send and check a CSRF token.",
     r"(?i)method\s*=\s*[\"'](?:POST|PUT|DELETE|PATCH)[\"']", r"(?i)csrf|_token|xsrf|csrfmiddlewaretoken", ("i", "method")),
    (56, "JWT in localStorage", "warning", "medium", "CWE-922", "A04:2021",
     "Keep tokens in http-only cookies.",
     r"(?i)localStorage\.setItem\s*\([^)]*(?:jwt|token|access_token|id_token|refresh_token)", None, ("i", "localstorage")),
    (57, "Secret compared by equality", "warning", "medium", "CWE-208", "A02:2021",
     "Compare in constant time.",
     r"(?i)(?:apiKey|token|secret|hash|signature|hmac)\s*(?:===?|!==?)\s*(?:req\.|request\.|body\.|params\.|query\.)",
     r"timingSafeEqual", ("==", "!=")),
    # Configuration
    (58, "Debug mode", "warning", "medium", "CWE-489", "A05:2021",
     "Switch debugging off in production.",
     r"(?:debug|DEBUG)\s*[:=]\s*(?:true|1|[\"'](?:true|1|on|yes)[\"'])", r"(?i)NODE_ENV|process\.env|test|development",
     ("debug", "DEBUG")),
    (59, "Error object logged", "info", "low", "CWE-532", "A09:2021",
     "Log the message, not the object.",
     r"console\.(?:log|error|warn)\s*\([^)]*(?:err\b|error\b)[^)]*\)", r"\.message|\.code", ("console.",)),
    (60, "Private address in code", "info", "low", "CWE-547", "A05:2021",
     "Read addresses from the configuration.",
     r"[\"'`](?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})[\"'`]",
     r"(?i)test|mock|example|localhost", ("10.", "172.", "192.168.")),
    (61, "TLS verification off", "critical", "high", "CWE-295", "A07:2021",
     "Repair the certificate instead.",
     r"(?:rejectUnauthorized|NODE_TLS_REJECT_UNAUTHORIZED)\s*[:=]\s*(?:false|0|[\"']0[\"'])", None,
     ("rejectUnauthorized", "NODE_TLS_REJECT")),
    # Data handling
    (62, "JSON.parse of input", "info", "low", "CWE-20", "A03:2021",
     "Guard the call with try and catch.",
     r"JSON\.parse\s*\(\s*(?:req\.|request\.|body|input|data|user|params)", r"try\s*\{", ("JSON.parse",)),
    (63, "Upload without type check", "critical", "high", "CWE-434", "A04:2021",
     "Check the type of uploaded files.",
     r"(?:multer|formidable|busboy|multiparty)\s*\(", r"(?i)fileFilter|mimetype|allowedTypes|accept",
     ("multer", "formidable", "busboy", "multiparty")),
    (64, "Interpolated SQL", "critical", "high", "CWE-89", "A03:2021",
     "Bind parameters.", r"\.(?:query|execute|run)\s*\(\s*`[^`]*\$\{", r"(?i)prepared|parameterized", ("${",)),
    (65, "Request body spread into query", "warning", "medium", "CWE-915", "A08:2021",
     "Pick the fields that may be written.",
     r"(?:\.create|\.update|\.insert|\.upsert)\s*\(\s*(?:\{[^}]*\.\.\.(?:req\.body|body|data))", None, ("...",)),
    (66, "Sensitive data logged", "warning", "medium", "CWE-532", "A09:2021",
     "Remove sensitive fields before logging.",
     r"(?i)console\.(?:log|info|warn|error|debug)\s*\([^)]*(?:password|passwd|secret|token|apiKey|creditCard|ssn|authorization)",
     r"(?i)redact|mask|sanitize|\*{3,}", ("i", "console.")),
    (67, "Unescaped HTML template", "critical", "high", "CWE-79", "A03:2021",
     "Escape values in HTML templates.",
     r"`<[^>]*\$\{(?:req\.|request\.|query\.|params\.|body\.|user|input)", None, ("${",)),
    (68, "Input without length check", "info", "low", "CWE-20", "A03:2021",
     "Limit the length of inputs.",
     r"(?:req\.body|req\.query|req\.params)\.\w+\s*(?:&&|\|\||;)",
     r"(?i)\.length|maxLength|max_length|\.slice|\.substring|limit", ("req.",)),
    (69, "Iframe without sandbox", "warning", "medium", "CWE-1021", "A05:2021",
     "Add the sandbox attribute.",
     r"<iframe[^>]*src\s*=\s*[{(]?\s*(?:\$\{|[+])", r"(?i)sandbox", ("<iframe",)),
]

#: rule 044 looks at the whole file and only fires in files that create an app
FILE_RULE = 44
APP_CONSTRUCTOR = r"(?:express|fastify)\s*\(\s*\)"


def js_rules() -> list[Rule]:
    out = []
    for no, name, sev, conf, cwe, owasp, advice, pattern, anti, anchors in _ROWS:
        per_file = no == FILE_RULE
        lower = anchors[0] == "i"
        out.append(
            Rule(
                rule_id=f"SG-{no:03d}",
                name=name,
                severity=sev,
                confidence=conf,
                cwe=cwe,
                owasp=owasp,
                message=name,
                suggestion=advice,
                languages=JS_TS,
                pattern=pattern,
                anti_pattern=anti,
                anti_scope=None if anti is None else ("file" if per_file else "window"),
                file_requires=APP_CONSTRUCTOR if per_file else None,
                once_per_file=per_file,
                skip_comments=True,
                anchors=anchors[1:] if lower else anchors,
                anchors_lower=lower,
            )
        )
    return out
