"""Detector accuracy on labelled rows: confusion counts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rules whose finding on safe code of a category is a false positive.
CATEGORY_RULES = {
    "SQL Injection": ("SG-002",), "XSS": ("SG-003",), "Command Injection": ("SG-022",), "Hardcoded Secrets": ("SG-001",),
    "Eval Injection": ("SG-023", "SG-009"), "SSRF": ("SG-012",), "Path Traversal": ("SG-021",),
    "Prototype Pollution": ("SG-010",), "Insecure Crypto": ("SG-004",), "NoSQL Injection": ("SG-011",),
    "Insecure Cookie": ("SG-013",), "Open Redirect": ("SG-006",),
}


def confusion(cases: DataFrame, findings: DataFrame, category_rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Counts per category from ``cases`` (case_id, category, vulnerable, expected_rule) and ``findings`` (case_id, rule_id).

    A vulnerable case counts as found by any rule; ``matched`` counts the
    expected rule alone.  A safe case is a false positive only for a rule of its
    own category (``category_rules``); categories that are not listed there
    take any rule.  A null label counts as safe.  Findings are reduced to flags
    per case before the join, so a case with many findings is one row.
    """
    rules = F.create_map(*[x for c, ids in (category_rules or {}).items() for x in (F.lit(c), F.array(*[F.lit(i) for i in ids]))]) if category_rules else None
    hits = findings.groupBy("case_id").agg(F.collect_set("rule_id").alias("rules"))  # as many as there are rules
    found = F.coalesce("rules", F.array().cast("array<string>"))
    own = F.size(found) > 0
    if rules is not None:
        own = F.when(rules[F.col("category")].isNull(), own).otherwise(F.arrays_overlap(found, rules[F.col("category")]))
    vulnerable = F.coalesce("vulnerable", F.lit(False))
    return cases.join(hits, "case_id", "left").groupBy("category").agg(
        F.count_if(vulnerable & (F.size(found) > 0)).alias("tp"),
        F.count_if(~vulnerable & own).alias("fp"),
        F.count_if(~vulnerable & ~own).alias("tn"),
        F.count_if(vulnerable & (F.size(found) == 0)).alias("fn"),
        F.count_if(vulnerable & F.array_contains(found, F.col("expected_rule"))).alias("matched"),
    )


def metrics(counts: DataFrame) -> DataFrame:
    """Percentages per category and overall (category NULL); 0 where undefined."""
    sums = counts.groupingSets([["category"], []], "category").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "matched")]
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    pct = lambda c: F.round(c * 100, 1)
    return sums.select(
        "category", "tp", "fp", "tn", "fn", "matched", pct(p).alias("precision"), pct(r).alias("recall"),
        pct(div(2 * p * r, p + r)).alias("f1"), pct(div(fp, fp + tn)).alias("fpr"), pct(div(tp + tn, tp + fp + tn + fn)).alias("accuracy"),
    )
