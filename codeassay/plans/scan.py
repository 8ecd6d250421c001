"""The static scan: files -> findings, as one narrow job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..catalog.js_rules import APP_CONSTRUCTOR, FILE_RULE, js_rules
from ..operators.detectors import STRUCTURAL, detector_emissions, js_emissions, rule_emission, secret_emissions
from ..operators.files import candidate_lines, language_of
from ..operators.matching import FINDING_COLUMNS, dedup_findings, findings_of


def with_language(corpus: DataFrame) -> DataFrame:
    """Keep files of a known language (by extension)."""
    if "language" in corpus.columns:
        return corpus.filter(F.col("language").isNotNull())
    return corpus.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull())


def _file_rule():
    rule = next(r for r in js_rules() if r.rule_id == f"SG-{FILE_RULE:03d}")
    return rule.pattern, rule.anti_pattern, APP_CONSTRUCTOR


def scan(
    corpus: DataFrame,
    *,
    mode: str = "pattern",
    config: dict | None = None,
    detectors=None,
    declarative: bool = True,
    secrets: bool = True,
    extra_rules=(),
    dedup: bool = True,
    keep: tuple = (),
    excerpt: bool = False,
) -> DataFrame:
    """Scan (repo, path, content) rows.

    ``detectors`` restricts the hand-written detectors to some numbers (``()``
    switches them off); ``extra_rules`` adds declarative rules at the end of
    the catalog; ``excerpt`` adds the numbered lines around a finding.  The job
    has no shuffle.
    """
    numbers = None if detectors is None else tuple(detectors)
    code = numbers is None or len(numbers) > 0
    emissions = detector_emissions(mode, numbers) if code else []
    if declarative:
        emissions += js_emissions()
    emissions += [rule_emission(r) for r in extra_rules]
    if secrets:
        emissions += secret_emissions()
    lines = candidate_lines(
        with_language(corpus),
        code=code or declarative or bool(extra_rules),
        secrets=secrets,
        context=code or declarative or bool(extra_rules) or excerpt,
        taint=code,
        templates=mode == "confirm" and (numbers is None or 2 in numbers),
        structure=mode == "confirm" and (numbers is None or bool(STRUCTURAL & set(numbers))),
        file_rule=_file_rule() if declarative else None,
        keep=keep,
    )
    return findings_of(lines, emissions, config=config, dedup=dedup, keep=keep, excerpt=excerpt)


def run_code_rule(corpus: DataFrame, rule) -> DataFrame:
    """A user rule written in Python: a function from a pandas frame of files
    (repo, path, language, content) to a frame of findings.  Arrow batches, no
    shuffle; union with ``scan(..., dedup=False)`` and ``dedup_findings``."""
    schema = (
        "repo string, file_path string, line int, column int, rule_id string, rule_name string, severity string, "
        "confidence string, message string, snippet string, cwe string, owasp string, suggestion string, verification string"
    )

    def batches(frames):
        for frame in frames:
            yield rule(frame)

    return with_language(corpus).select("repo", "path", "language", "content").mapInPandas(batches, schema)


def scan_results(corpus: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per scanned file with its findings; clean files are kept.

    A file's findings are at most one per line, so the nested array is bounded
    by the file itself.
    """
    nested = findings.groupBy("repo", "file_path").agg(
        F.array_sort(
            F.collect_list(F.struct("line", *[c for c in FINDING_COLUMNS if c not in ("repo", "file_path", "line")]))
        ).alias("findings")
    )
    files = with_language(corpus).select("repo", F.col("path").alias("file_path"), "language")
    return files.join(nested, ["repo", "file_path"], "left").withColumn(
        "findings", F.coalesce("findings", F.array().cast(nested.schema["findings"].dataType))
    )


__all__ = ["scan", "scan_results", "run_code_rule", "dedup_findings", "with_language"]
