"""Registered queries: accuracy of the detectors on labelled code, and of text rules on the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import detectors as cat
from ..operators import evaluate as ev
from ..sources import cases as ca, derived as d
from ..sources.oracle_views import q
from . import sast_oracle as so
from .scan import scan

QUERIES: dict = {}
ORACLE: dict = {}

#: Rules that are held against the human labels: id and pattern.
RULES = {
    "T-CONTACT": r"@[a-z0-9]+\.", "T-TOKEN": r"(?i)token\s*=", "T-NUMBER": r"[0-9]{13,}", "T-LICENSE": r"(?i)\blicensed?\b", "T-SHOUT": r"[A-Z]{3,}!!",
}
#: Rules whose finding on a document of good quality counts as a false positive, by source.
SOURCE_RULES = {"src0": ("T-CONTACT", "T-NUMBER"), "src1": ("T-SHOUT",)}


def labelled(spark, sf, label):
    """Every labelled document as a case, and what the rules find in whole texts."""
    rows = d.table(spark, sf, "labels").join(d.table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    found = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(i)) for i, p in RULES.items()]), lambda x: x.isNotNull())
    cases = rows.select(F.col("doc_id").alias("case_id"), F.col("source").alias("category"), F.expr(label).alias("vulnerable"), F.lit("T-SHOUT").alias("expected_rule"))
    return cases, rows.select(F.col("doc_id").alias("case_id"), F.explode(found).alias("rule_id"))


JUNK, TOXIC = "quality = 0", "toxic = 1"
_HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{i}' END" for i, p in RULES.items())
_OWN = " ".join(f"WHEN category = '{c}' THEN " + " OR ".join(f"list_contains(hits, '{i}')" for i in ids) for c, ids in SOURCE_RULES.items())


def _counts_sql(truth: str, own: str) -> str:
    return f"""j AS (SELECT d.source AS category, {truth} AS truth, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS hits FROM labels l JOIN documents d USING (doc_id)),
  c AS (SELECT category, count(*) FILTER (WHERE truth AND len(hits) > 0) AS tp, count(*) FILTER (WHERE NOT truth AND ({own})) AS fp,
    count(*) FILTER (WHERE NOT truth AND NOT ({own})) AS tn, count(*) FILTER (WHERE truth AND len(hits) = 0) AS fn,
    count(*) FILTER (WHERE truth AND list_contains(hits, 'T-SHOUT')) AS matched FROM j GROUP BY 1)"""


_BY_SOURCE = f"CASE {_OWN} ELSE len(hits) > 0 END"
QUERIES["accuracy_confusion"] = lambda spark, sf: ev.confusion(*labelled(spark, sf, JUNK), SOURCE_RULES)
ORACLE["accuracy_confusion"] = f"WITH {_counts_sql('l.quality = 0', _BY_SOURCE)} SELECT category, tp, fp, tn, fn, matched FROM c"

QUERIES["accuracy_metrics"] = lambda spark, sf: ev.metrics(ev.confusion(*labelled(spark, sf, JUNK), SOURCE_RULES)).select(
    F.coalesce("category", F.lit("overall")).alias("category"), "tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr", "accuracy"
)
_DIV = lambda a, b: f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END"
ORACLE["accuracy_metrics"] = f"""WITH {_counts_sql('l.quality = 0', _BY_SOURCE)},
  s AS (SELECT coalesce(category, 'overall') AS category, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM c GROUP BY GROUPING SETS ((category), ())),
  m AS (SELECT *, {_DIV('tp', 'tp + fp')} AS p, {_DIV('tp', 'tp + fn')} AS r FROM s)
  SELECT category, tp, fp, tn, fn, round(p * 100, 1) AS precision, round(r * 100, 1) AS recall, round({_DIV('2 * p * r', 'p + r')} * 100, 1) AS f1,
    round({_DIV('fp', 'fp + tn')} * 100, 1) AS fpr, round({_DIV('tp + tn', 'tp + fp + tn + fn')} * 100, 1) AS accuracy FROM m"""

QUERIES["accuracy_labelled_documents"] = lambda spark, sf: ev.confusion(*labelled(spark, sf, TOXIC)).select("category", "tp", "fp", "tn", "fn")
ORACLE["accuracy_labelled_documents"] = f"WITH {_counts_sql('l.toxic = 1', 'len(hits) > 0')} SELECT category, tp, fp, tn, fn FROM c"


# ------------------------------------------------------------- detectors on labelled code
def _rated(spark, sf):
    cases = ca.cases(spark, sf)
    found = scan(cases.select("repo", "path", "content"), mode="confirm", dedup=False).select(F.col("file_path").alias("case_id"), "rule_id")
    return ev.confusion(cases, found, ev.CATEGORY_RULES)


def _cases_sql() -> str:
    rows = ", ".join(f"({n}, {q(c)}, {q(e)}, {q(r) if r else 'NULL'}, {q(t)})" for n, (c, e, r, t) in enumerate(ca.CASES))
    return f"""samples(n, category, ext, rule, code) AS (VALUES {rows}),
corpus AS (SELECT 'cases' AS repo, 'case' || doc_id || '.' || ext AS path, replace(code, '#', CAST(doc_id AS VARCHAR)) AS content, category, rule FROM documents JOIN samples ON n = doc_id % {len(ca.CASES)})"""


def _rated_sql() -> str:
    own = " ".join(f"WHEN {q(c)} THEN list_has_any(rules, [{', '.join(q(r) for r in ids)}])" for c, ids in ev.CATEGORY_RULES.items())
    found = so.scan_sql(numbers=cat.META, declarative=True, secrets=True, confirm=True, source=_cases_sql())
    return f"""WITH {_cases_sql()}, found AS (SELECT file_path, list(DISTINCT rule_id) AS rules FROM ({found}) GROUP BY 1),
  j AS (SELECT category, rule, coalesce(rules, []) AS rules FROM corpus LEFT JOIN found ON file_path = path),
  c AS (SELECT category, count(*) FILTER (WHERE rule IS NOT NULL AND len(rules) > 0) AS tp, count(*) FILTER (WHERE rule IS NULL AND CASE category {own} END) AS fp,
    count(*) FILTER (WHERE rule IS NULL AND NOT CASE category {own} END) AS tn, count(*) FILTER (WHERE rule IS NOT NULL AND len(rules) = 0) AS fn,
    count(*) FILTER (WHERE list_contains(rules, rule)) AS matched FROM j GROUP BY 1)"""


QUERIES["detector_confusion"] = _rated
ORACLE["detector_confusion"] = f"{_rated_sql()} SELECT category, tp, fp, tn, fn, matched FROM c"

QUERIES["detector_accuracy"] = lambda spark, sf: ev.metrics(_rated(spark, sf)).select(
    F.coalesce("category", F.lit("overall")).alias("category"), "tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr", "accuracy"
)
ORACLE["detector_accuracy"] = f"""{_rated_sql()}, s AS (SELECT coalesce(category, 'overall') AS category, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM c GROUP BY GROUPING SETS ((category), ())),
  m AS (SELECT *, {_DIV('tp', 'tp + fp')} AS p, {_DIV('tp', 'tp + fn')} AS r FROM s)
  SELECT category, tp, fp, tn, fn, round(p * 100, 1) AS precision, round(r * 100, 1) AS recall, round({_DIV('2 * p * r', 'p + r')} * 100, 1) AS f1,
    round({_DIV('fp', 'fp + tn')} * 100, 1) AS fpr, round({_DIV('tp + tn', 'tp + fp + tn + fn')} * 100, 1) AS accuracy FROM m"""
