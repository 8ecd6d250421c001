"""Licence classification and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import registries as reg
from .advisories import dev_label


def classify_license(spdx: Column) -> Column:
    """Exact, case-sensitive lookup: critical, warning or none."""
    t = F.trim(spdx)
    return F.when(t.isin(*reg.STRONG_COPYLEFT), "critical").when(t.isin(*reg.WEAK_COPYLEFT), "warning").otherwise("none")


def license_risk(expression: Column) -> Column:
    """Worst risk over the parts of a licence expression."""
    parts = F.filter(F.split(expression, r"(?i)\s+OR\s+|\s+AND\s+|\s*\(\s*|\s*\)\s*"), lambda p: p != "")
    risks = F.transform(parts, classify_license)
    return (
        F.when(F.array_contains(risks, "critical"), "critical").when(F.array_contains(risks, "warning"), "warning").otherwise("none")
    )


def license_findings(dependencies: DataFrame, scan: str = "repo") -> DataFrame:
    """Copyleft findings over distinct dependencies; a pure projection."""
    d = dependencies.filter(F.coalesce("license", F.lit("")) != "").withColumn("_risk", license_risk(F.col("license")))
    d = d.filter(F.col("_risk") != "none")
    strong = F.col("_risk") == "critical"
    name, label = F.col("name"), dev_label(F.col("dev"))
    return d.select(
        scan,
        F.when(strong, "LICENSE-COPYLEFT").otherwise("LICENSE-WEAK-COPYLEFT").alias("rule_id"),
        F.concat(F.lit("Copyleft license: "), name, label).alias("rule_name"),
        F.col("_risk").alias("severity"),
        F.lit("high").alias("confidence"),
        F.concat(
            name, F.lit("@"), F.col("version"), label, F.lit(" uses "), F.col("license"), F.lit(", a "),
            F.when(strong, "strong").otherwise("weak"), F.lit(" copyleft license."),
        ).alias("message"),
        F.col("source").alias("file_path"),
        "line",
        F.lit(1).alias("column"),
        F.concat(
            F.lit("["), F.col("ecosystem"), F.lit('] "'), name, F.lit('": "'), F.col("version"), F.lit('" \u2014 License: '), F.col("license")
        ).alias("snippet"),
        F.lit("").alias("cwe"),
        F.lit("").alias("owasp"),
        F.when(strong, F.concat(F.lit("Replace "), name, F.lit(" with a permissively licensed package.")))
        .otherwise(F.concat(F.lit("Review the terms of "), F.col("license"), F.lit(".")))
        .alias("suggestion"),
    )


def license_distribution(dependencies: DataFrame, scan: str | None = None, top: int = 8) -> DataFrame:
    """Most frequent licences (ties by name), overall or per scan."""
    keys = [scan] if scan else []
    counts = dependencies.filter(F.coalesce("license", F.lit("")) != "").groupBy(*keys, "license").agg(F.count("*").alias("n"))
    if not keys:
        return counts.orderBy(F.desc("n"), "license").limit(top)
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "license")
    return counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top).drop("_rn")
