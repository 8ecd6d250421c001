"""File-level preparation: language, ignore rules, taint sets, candidate lines.

One projection per file, no shuffle.  A line leaves the file as a row only if
it can possibly match something, and then carries the few neighbours the rules
look at, so nothing after this point needs a window or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import registries as reg
from ..catalog.secrets import GATE_ASSIGN, GATE_RUN
from ..functions.regex import alternation
from ..functions.text import lines_of, numbered, rx, words_of
from .structure import line_facts

#: Lines around a candidate that rules look at; calls and loops are looked up in the bracket index of the file.
BEFORE, AFTER = 5, 5

#: lines without any of these cannot match a code rule
CODE_GATE = (
    r"[(=:<`\"']|debugger|__proto__|prototype|(?i:NEXT_PUBLIC_)|ObjectInputStream|dangerouslySetInnerHTML|req\."
)
JS_DECL = r"\b(?:const|let|var)\s+"
JS_INPUT = r"(?:req|request)\.(?:params|query|body|headers)"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, NULL when unknown."""
    ext = extension(path)
    expr = None
    for lang in ("javascript", "typescript", "python"):
        exts = [e for e, l in reg.EXTENSION_LANGUAGE.items() if l == lang]
        expr = F.when(ext.isin(exts), lang) if expr is None else expr.when(ext.isin(exts), lang)
    return expr


# ---------------------------------------------------------------- taint sets
def _assignments(lines: Column) -> Column:
    """Python ``name = rest`` lines in order (also accepts ``x == y``)."""
    hits = F.filter(lines, lambda t: t.rlike(r"^\s*\w+\s*="))
    return F.transform(
        hits,
        lambda t: F.struct(
            F.regexp_extract(t, r"^\s*(\w+)\s*=", 1).alias("v"),
            t.substr(F.instr(t, "=") + 1, F.length(t)).alias("rhs"),
        ),
    )


def py_tainted(lines: Column, web_only: bool = False, transitive: str = "forward") -> Column:
    """Names assigned from input, plus one forward pass in line order."""
    source = reg.PY_INPUT_WEB if web_only else reg.PY_INPUT
    assigns = _assignments(lines)
    seeds = F.array_distinct(F.transform(F.filter(assigns, lambda a: rx(a["rhs"], source)), lambda a: a["v"]))
    if transitive == "none":
        return seeds
    return F.aggregate(
        assigns,
        seeds,
        lambda acc, a: F.when(
            ~F.array_contains(acc, a["v"])
            & F.arrays_overlap(acc, F.regexp_extract_all(a["rhs"], F.lit(r"(\w+)"), F.lit(1))),
            F.array_append(acc, a["v"]),
        ).otherwise(acc),
    )


def py_sanitized(lines: Column, category: str) -> Column:
    names = reg.py_sanitizer_names(category)
    if not names:
        return F.array().cast("array<string>")
    call = alternation(names)
    return F.array_distinct(
        F.transform(F.filter(_assignments(lines), lambda a: rx(a["rhs"], call)), lambda a: a["v"])
    )


def py_shell_quoted(lines: Column) -> Column:
    """Names assigned directly from a shell quoting call."""
    pattern = r"^\s*(\w+)\s*=\s*(?:shlex\.quote|pipes\.quote|quote)\s*\("
    return F.array_distinct(
        F.transform(F.filter(lines, lambda t: t.rlike(pattern)), lambda t: F.regexp_extract(t, pattern, 1))
    )


def py_sql_variables(lines: Column) -> Column:
    """Names that hold SQL text built from parts."""
    return F.array_distinct(
        F.transform(
            F.filter(
                _assignments(lines),
                lambda a: rx(a["rhs"], r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b")
                & a["rhs"].rlike(r"[+]|\.format\s*\(|f[\"']"),
            ),
            lambda a: a["v"],
        )
    )


def js_tainted(content: Column) -> Column:
    """Variables declared from request members, plain or by destructuring."""
    end = r"[\w.$]*\s*(?:[;,\n)]|$)"
    plain = F.regexp_extract_all(
        content, F.lit(rf"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*{JS_INPUT}{end}"), F.lit(1)
    )
    groups = F.regexp_extract_all(
        content, F.lit(rf"(?:const|let|var)\s*\{{([^}}]*)\}}\s*=\s*{JS_INPUT}{end}"), F.lit(1)
    )
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    named = F.transform(parts, lambda p: F.regexp_extract(p, r"^\s*(?:[\w$]+\s*:\s*)?([A-Za-z_$][\w$]*)\s*$", 1))
    return F.array_distinct(F.concat(plain, F.filter(named, lambda v: v != "")))


def js_sanitized(content: Column, category: str) -> Column:
    names = "|".join(n.replace(".", r"\.") for n in reg.js_sanitizer_names(category, with_universal=False))
    if not names:
        return F.array().cast("array<string>")
    return F.array_distinct(
        F.regexp_extract_all(
            content,
            F.lit(rf"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:{names})\s*\("),
            F.lit(1),
        )
    )


def _tag(kind: str, names: Column) -> Column:
    return F.transform(names, lambda v: F.struct(F.lit(kind).alias("k"), v.alias("v")))


TAG_TYPE = "array<struct<k:string,v:string>>"


def file_tags(language: Column, content: Column, lines: Column) -> Column:
    """All (kind, name) facts of a file; empty for files without sources or sanitizers."""
    none = F.array().cast(TAG_TYPE)
    py = F.concat(
        _tag("src", py_tainted(lines)),
        _tag("sqlvar", py_sql_variables(lines)),
        _tag("quoted", py_shell_quoted(lines)),
        *[_tag(f"san-{c}", py_sanitized(lines, c)) for c in ("xss", "path", "ssrf")],
    )
    js = F.concat(
        _tag("src", js_tainted(content)),
        *[_tag(f"san-{c}", js_sanitized(content, c)) for c in ("xss", "sql", "cmd", "path", "ssrf")],
    )
    return (
        F.when((language == "python") & content.rlike(r"(?m)^\s*\w+\s*="), py)
        .when((language != "python") & content.rlike(r"(?:const|let|var)\s"), js)
        .otherwise(none)
    )


# ----------------------------------------------------- multi-line SQL templates
def sql_template_lines(content: Column, sanitized: Column) -> Column:
    """Start lines of template literals that span lines, hold SQL and interpolate
    at least one value that is not sanitized."""
    safe_call = r"^\s*(?:" + "|".join(
        n.replace(".", r"\.") for n in reg.js_sanitizer_names("sql")
    ) + r")\s*\("

    def unsafe(seg: Column) -> Column:
        values = F.regexp_extract_all(seg, F.lit(r"\$\{([^}]*)\}"), F.lit(1))
        return F.exists(
            values,
            lambda e: ~e.rlike(safe_call) & ~F.array_contains(sanitized, F.trim(e)),
        )

    segments = F.split(content, "`", -1)
    start = F.struct(
        F.lit(1).alias("line"), F.lit(False).alias("inside"), F.array().cast("array<int>").alias("out")
    )
    folded = F.aggregate(
        segments,
        start,
        lambda acc, s: F.struct(
            (acc["line"] + F.size(F.split(s, "\n", -1)) - 1).alias("line"),
            (~acc["inside"]).alias("inside"),
            F.when(
                acc["inside"]
                & s.contains("\n")
                & s.contains("${")
                & rx(s, r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\b")
                & unsafe(s),
                F.array_append(acc["out"], acc["line"]),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    gate = content.contains("`") & content.contains("${") & content.rlike(
        r"(?i)select|insert|update|delete|drop|alter"
    )
    return F.when(gate, folded).otherwise(F.array().cast("array<int>"))


# ------------------------------------------------------------- candidate lines
def candidate_lines(
    files: DataFrame,
    *,
    code: bool = True,
    secrets: bool = True,
    context: bool = True,
    taint: bool = True,
    templates: bool = False,
    structure: bool = False,
    file_rule: tuple[str, str, str] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``files`` (repo, path, language, content) -> candidate lines.

    Columns: repo, path, language, line_no, text, before, after, tags,
    template_start, file_rule_line plus ``keep``.  With ``structure`` also
    facts: the calls that begin on the line and the loop around it.
    """
    none_tags = F.array().cast(TAG_TYPE)
    prepared = files.select(
        "repo", "path", "language", *keep, "content", lines_of(F.col("content")).alias("_lines")
    )
    is_js = F.col("language") != "python"
    cols = {
        "_tags": file_tags(F.col("language"), F.col("content"), F.col("_lines")) if taint else none_tags,
        "_templates": F.when(is_js, sql_template_lines(F.col("content"), js_sanitized(F.col("content"), "sql"))).otherwise(
            F.array().cast("array<int>")
        )
        if templates
        else F.array().cast("array<int>"),
        "_file_line": F.lit(None).cast("int"),
    }
    if structure:
        cols["_facts"] = line_facts(is_js, F.col("content"))
    if file_rule is not None:
        pattern, anti, requires = file_rule
        first = F.filter(
            numbered(F.col("_lines")),
            lambda x: x["t"].rlike(pattern) & ~x["t"].rlike(r"^\s*(?://|\*)"),
        )
        cols["_file_line"] = F.when(
            is_js & F.col("content").rlike(requires) & ~F.col("content").rlike(anti), F.get(first, F.lit(0))["n"]
        )
    prepared = prepared.withColumns(cols)

    def gate(t: Column) -> Column:
        tests = []
        if secrets:
            tests += [
                t.rlike(GATE_ASSIGN), t.rlike(GATE_RUN), t.contains("://"), t.contains("-----BEGIN"),
                t.contains("service_account"), t.contains("AccountKey="), t.contains("sig="), t.contains("define("),
            ]
        if code:
            tests = [t.rlike(CODE_GATE)] + tests
        out = tests[0]
        for x in tests[1:]:
            out = out | x
        return out

    lines = F.col("_lines")

    def pick(t: Column, i: Column) -> Column:
        fields = [(i + 1).alias("line_no"), t.alias("text")]
        if context:
            fields += [
                F.slice(lines, F.greatest(i + 1 - BEFORE, F.lit(1)), F.least(i, F.lit(BEFORE))).alias("before"),
                F.slice(lines, i + 1, F.lit(AFTER + 1)).alias("after"),
            ]
        if structure:
            fields.append(F.get(F.col("_facts"), i).alias("facts"))
        return F.when(gate(t) | F.array_contains(F.col("_templates"), i + 1), F.struct(*fields))

    picked = F.filter(F.transform(lines, pick), lambda x: x.isNotNull())
    rows = prepared.select(
        "repo", "path", "language", *keep, "_tags", "_templates", "_file_line", F.explode(picked).alias("_c")
    )
    empty = F.array().cast("array<string>")
    rows = rows.withColumn(
        "_words", F.when(F.size("_tags") > 0, words_of(F.col("_c.text"))) if taint else F.lit(None).cast("array<string>")
    )
    tags = F.when(
        F.col("_words").isNotNull(),
        F.filter(F.col("_tags"), lambda x: F.array_contains(F.col("_words"), x["v"])),
    ).otherwise(none_tags)
    return rows.select(
        "repo",
        "path",
        "language",
        *keep,
        F.col("_c.line_no").alias("line_no"),
        F.col("_c.text").alias("text"),
        (F.col("_c.before") if context else empty).alias("before"),
        (F.col("_c.after") if context else empty).alias("after"),
        (tags if taint else none_tags).alias("tags"),
        F.array_contains(F.col("_templates"), F.col("_c.line_no")).alias("template_start"),
        (F.col("_file_line") == F.col("_c.line_no")).alias("file_rule_line"),
        *([F.col("_c.facts").alias("facts")] if structure else []),
    )
