"""Turn emissions into findings.

All outcomes of all emissions are numbered by (severity rank, longer rule id
first, report order).  The number of an outcome is therefore its priority, so
keeping one finding per line is ``least(...)`` over the line's outcomes: no
shuffle, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regex import spark_regex
from ..functions.text import constant_table, js_trim
from .detectors import Emission, family_gate

ATTRIBUTE_TYPE = (
    "array<struct<rule_id string, rule_name string, severity string, confidence string, message string, cwe string, "
    "owasp string, suggestion string, pattern string, secret boolean, verification string>>"
)
RANK = {"critical": 0, "warning": 1, "info": 2}

FINDING_COLUMNS = (
    "repo", "file_path", "line", "column", "rule_id", "rule_name", "severity", "confidence",
    "message", "snippet", "cwe", "owasp", "suggestion", "verification",
)


class Compiled:
    """Numbered outcomes plus the expressions that yield them."""

    def __init__(self, emissions: list[Emission], config: dict | None = None):
        config = config or {}
        rows = []
        for seq, e in enumerate(emissions):
            setting = config.get(e.rule_id)
            if setting is False or (isinstance(setting, dict) and setting.get("enabled") is False):
                continue
            override = setting.get("severity") if isinstance(setting, dict) else None
            for k, o in enumerate(e.outcomes):
                rows.append((RANK.get(override or o.severity, 2), -len(e.rule_id), seq, k, e, o, override or o.severity))
        rows.sort(key=lambda r: r[:4])
        self.table = []
        number = {}
        for i, (_, _, seq, k, e, o, severity) in enumerate(rows, start=1):
            number[(seq, k)] = i
            self.table.append((e, o, severity))
        self._flat, self._families, self._languages = [], {}, set()
        for seq, e in enumerate(emissions):
            if (seq, 0) not in number:
                continue
            self._languages.update(e.languages)
            value = self._value(e, [number[(seq, k)] for k in range(len(e.outcomes))])
            if e.family is None:
                self._flat.append((e.languages, F.when(e.condition, value)))
            else:
                self._families.setdefault(e.family, []).append(F.when(e.condition, value))

    @staticmethod
    def _value(e: Emission, numbers: list[int]) -> Column:
        out = None
        for o, n in zip(e.outcomes, numbers):
            if o.when is None:
                return F.lit(n) if out is None else out.otherwise(F.lit(n))
            out = F.when(o.when, F.lit(n)) if out is None else out.when(o.when, F.lit(n))
        return out

    def _groups(self):
        by_language = {}
        for languages, expr in self._flat:
            by_language.setdefault(tuple(languages), []).append(expr)
        for languages, exprs in by_language.items():
            yield (None if len(languages) == 3 else F.col("language").isin(list(languages))), exprs
        for family, exprs in self._families.items():
            yield family_gate(family), exprs

    def all_hits(self) -> Column:
        """Every outcome of the line."""
        empty = F.array().cast("array<int>")
        parts = []
        for gate, exprs in self._groups():
            arr = F.array_compact(F.array(*exprs))
            parts.append(arr if gate is None else F.when(gate, arr).otherwise(empty))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def best_hit(self) -> Column:
        """The one outcome that survives duplicate suppression, or NULL."""
        parts = []
        for gate, exprs in self._groups():
            one = F.least(*exprs) if len(exprs) > 1 else exprs[0]
            parts.append(one if gate is None else F.when(gate, one))
        return F.least(*parts) if len(parts) > 1 else parts[0]

    def attributes(self) -> Column:
        """Lookup table indexed by outcome number; a constant for the optimizer."""
        rows = [
            dict(
                rule_id=e.rule_id, rule_name=e.name, severity=severity, confidence=o.confidence, message=o.message,
                cwe=e.cwe, owasp=e.owasp, suggestion=e.suggestion,
                pattern="" if e.column_pattern is None else spark_regex(e.column_pattern), secret=e.secret,
                verification="confirmed" if e.confirmed else "pattern",
            )
            for e, o, severity in self.table
        ]
        return constant_table(rows, ATTRIBUTE_TYPE)


def _once(expr: Column) -> Column:
    """Row generator that evaluates a very wide expression exactly once per line.

    As a plain column it would be computed again by the filter that Spark
    pushes below it, and whole-stage code generation would put it into one
    method that the JVM does not compile.  The lambda over one value keeps it
    out of there.
    """
    return F.explode(F.array(F.when(F.exists(F.array("line_no"), lambda n: n.isNotNull()), expr)))


def findings_of(
    lines: DataFrame, emissions: list[Emission], *, config: dict | None = None, dedup: bool = False, keep: tuple = (),
    excerpt: bool = False,
) -> DataFrame:
    """Candidate lines -> findings, all of them or one per line."""
    compiled = Compiled(emissions, config)
    if excerpt:
        near = F.concat("before", F.slice("after", 1, 6))
        first = F.col("line_no") - F.size("before")
        text = F.array_join(F.transform(near, lambda t, i: F.concat((first + i).cast("string"), F.lit(": "), t)), "\n")
        lines, keep = lines.withColumn("excerpt", text), (*keep, "excerpt")
    if dedup:
        hits = lines.withColumn("_h", _once(compiled.best_hit())).filter(F.col("_h").isNotNull())
    else:
        hits = lines.withColumn("_hs", _once(compiled.all_hits())).withColumn("_h", F.explode("_hs"))
    hits = hits.select(
        "repo", "path", "line_no", "text", *keep, F.element_at(compiled.attributes(), F.col("_h")).alias("a")
    )
    pattern = F.col("a.pattern")
    matched = F.regexp_substr(F.col("text"), pattern)
    snippet = js_trim(F.col("text"))
    masked = F.when(
        F.col("a.secret"), F.replace(snippet, matched, F.concat(F.substring(matched, 1, 4), F.lit("****")))
    ).otherwise(snippet)
    return hits.select(
        "repo",
        F.col("path").alias("file_path"),
        F.col("line_no").alias("line"),
        F.when(pattern == "", F.lit(1)).otherwise(F.regexp_instr(F.col("text"), pattern)).alias("column"),
        F.col("a.rule_id").alias("rule_id"),
        F.col("a.rule_name").alias("rule_name"),
        F.col("a.severity").alias("severity"),
        F.col("a.confidence").alias("confidence"),
        F.col("a.message").alias("message"),
        masked.alias("snippet"),
        F.col("a.cwe").alias("cwe"),
        F.col("a.owasp").alias("owasp"),
        F.col("a.suggestion").alias("suggestion"),
        F.col("a.verification").alias("verification"),
        *keep,
    )


def apply_config(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Switch rules off and override severities from a settings table
    (rule_id, enabled, severity); the table has at most one row per rule."""
    cfg = config.select(
        "rule_id", F.col("enabled").alias("_enabled"), F.col("severity").alias("_severity")
    )
    return (
        findings.join(cfg, "rule_id", "left")
        .filter(F.coalesce(F.col("_enabled"), F.lit(True)))
        .withColumn("severity", F.coalesce("_severity", "severity"))
        .drop("_enabled", "_severity")
    )


def dedup_findings(findings: DataFrame, keys=("repo", "file_path", "line"), order=("seq",)) -> DataFrame:
    """One finding per line: severest, then longest rule id, then first reported.

    The general form for findings that come from different jobs.  Groups are
    single source lines; the aggregate pre-reduces before the shuffle, so many
    copies of one line do not gather in one task.
    """
    from ..functions.text import severity_rank

    rest = [c for c in findings.columns if c not in keys]
    best = F.min(
        F.struct(
            severity_rank(F.col("severity")).alias("_rank"),
            (-F.length("rule_id")).alias("_len"),
            *[F.col(o).alias(f"_o_{o}") for o in order],
            *[F.col(c) for c in rest],
        )
    )
    return findings.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
