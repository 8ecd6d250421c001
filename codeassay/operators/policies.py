"""User policies over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import registries as reg
from .joins import salted_join
from .ranking import grouped_index

CONDITIONS = (
    "STRUCT<severity_gte:STRING, reachable_only:BOOLEAN, source:STRING, cwe_ids:ARRAY<STRING>, "
    "package_patterns:ARRAY<STRING>, include_dev_deps:BOOLEAN, license_types:ARRAY<STRING>>"
)
ACTIONS = ("block", "warn", "ignore")


def order_of(severity: Column) -> Column:
    return F.when(severity == "critical", 2).when(severity == "warning", 1).when(severity == "info", 0)


def parse_conditions(json_text: Column) -> Column:
    return F.from_json(json_text, CONDITIONS)


def validate_policies(submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``error``); optional fields get their defaults."""
    missing = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("action", F.lit("")) == "")
    error = F.when(missing, "name and action are required").when(
        ~F.col("action").isin(*ACTIONS), "action must be block, warn, or ignore"
    )
    checked = submitted.withColumn("error", error)
    accepted = checked.filter(F.col("error").isNull()).drop("error").withColumns(
        {"description": F.coalesce("description", F.lit("")), "conditions": F.coalesce("conditions", F.lit("{}"))}
    )
    return accepted, checked.filter(F.col("error").isNotNull())


def policies_in_scope(scans: DataFrame, policies: DataFrame) -> DataFrame:
    """(scan_id, policy columns) for enabled policies of the user, global or of the project."""
    p = policies.filter("enabled").withColumnRenamed("project_id", "_policy_project")
    return (
        salted_join(scans.select("scan_id", "project_id", "user_id"), p, ["user_id"])
        .filter(F.col("_policy_project").isNull() | (F.col("_policy_project") == F.col("project_id")))
        .drop("_policy_project", "project_id", "user_id")
    )


def policy_attributes(findings: DataFrame) -> DataFrame:
    """Package name and development flag, read from the rule name."""
    return findings.withColumns(
        {
            "package_name": F.nullif(F.regexp_extract("rule_name", r"^Vulnerable dependency:\s*(\S+)", 1), F.lit("")),
            "is_dev": F.coalesce(F.contains("rule_name", F.lit("(dev)")), F.lit(False)),
        }
    )


def glob_match(value: Column, pattern: Column) -> Column:
    """``*`` matches anything; every other character stands for itself."""
    parts = F.transform(F.split(pattern, r"\*", -1), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    return F.regexp_like(value, F.concat(F.lit("^"), F.array_join(parts, ".*"), F.lit("$")))


def has_patterns(c: Column) -> Column:
    return F.coalesce(F.size(c["package_patterns"]), F.lit(-1)) > 0


def matches(c: Column) -> Column:
    """All conditions of ``c`` but its package patterns hold (see ``pattern_hits``); an absent condition always holds."""
    rule = F.col("rule_id")
    is_sca, is_lic = rule.startswith("SCA-"), rule.startswith("LICENSE-")
    source = c["source"]
    ok = lambda cond: F.coalesce(cond, F.lit(False))
    return (
        F.coalesce(order_of(F.col("severity")) >= order_of(c["severity_gte"]), F.lit(True))
        & (~F.coalesce(c["reachable_only"], F.lit(False)) | ok(F.col("reachable")))
        & (
            F.coalesce(source, F.lit("")).isin("sast", "sca", "license").__invert__()
            | ((source == "sast") & ~is_sca & ~is_lic)
            | ((source == "sca") & is_sca)
            | ((source == "license") & is_lic)
        )
        & ((F.coalesce(F.size(c["cwe_ids"]), F.lit(-1)) < 1) | ok(F.array_contains(c["cwe_ids"], F.coalesce("cwe", F.lit("")))))
        & ~(ok(~c["include_dev_deps"]) & F.col("is_dev"))
        & (
            (F.coalesce(F.size(c["license_types"]), F.lit(-1)) < 1)
            | (F.array_contains(c["license_types"], "strong-copyleft") & (rule == "LICENSE-COPYLEFT"))
            | (F.array_contains(c["license_types"], "weak-copyleft") & (rule == "LICENSE-WEAK-COPYLEFT"))
        )
    )


def without_markers(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("rule_id").isin(*reg.MARKER_RULES))


def pattern_hits(scoped: DataFrame, findings: DataFrame) -> DataFrame:
    """(scan_id, package_name, policy_id): packages of a scan that meet a package pattern of one of its policies.

    Patterns are indexed by the longer of the literal texts before the first and
    after the last ``*``; a package offers its own beginnings and ends of the
    lengths that occur, so it meets only patterns whose literal fits.  Each
    package and each pattern of a scan is tried once, whatever the number of
    findings and policies.  Patterns that are literal at neither end meet all
    packages of their scan.
    """
    wanted = scoped.filter(has_patterns(F.col("conditions")))
    wanted = wanted.select("scan_id", "policy_id", F.explode(F.array_distinct(F.col("conditions.package_patterns"))).alias("pattern")).filter("pattern is not null")
    head, tail = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    by_tail = F.char_length(tail) > F.char_length(head)
    keyed = wanted.select("scan_id", "pattern").distinct().withColumn("literal", F.when(by_tail, tail).otherwise(head))
    keyed = keyed.select("scan_id", "pattern", "literal", by_tail.alias("at_end"))
    lengths = keyed.groupBy("scan_id").agg(F.collect_set(F.struct("at_end", F.char_length("literal").alias("n"))).alias("ends"))
    packages = findings.filter("package_name is not null").select("scan_id", "package_name").distinct()
    name = F.col("package_name")
    fitting = packages.join(lengths, "scan_id").select("scan_id", "package_name", F.explode("ends").alias("e")).filter(F.col("e.n") <= F.char_length(name))
    literal = F.when(F.col("e.at_end"), F.right(name, F.col("e.n"))).otherwise(F.left(name, F.col("e.n")))
    offered = fitting.select("scan_id", "package_name", F.col("e.at_end").alias("at_end"), literal.alias("literal"))
    hits = salted_join(offered, keyed, ["scan_id", "at_end", "literal"]).filter(glob_match(name, F.col("pattern")))
    return hits.select("scan_id", "package_name", "pattern").join(wanted, ["scan_id", "pattern"]).select("scan_id", "package_name", "policy_id").distinct()


def policy_matches(scoped: DataFrame, findings: DataFrame, order: list[str], with_index: bool = True) -> DataFrame:
    """(scan_id, policy_id, idx): one row per match.

    ``idx`` is the 0-based position of the finding in its scan.  Rows, not
    arrays: a scan of any size stays spread over the cluster.  A finding meets
    the policies without package patterns and those whose patterns its package
    fits.
    """
    f = policy_attributes(without_markers(findings))
    hits = pattern_hits(scoped, f)
    if with_index:
        f = grouped_index(f, "scan_id", order)
    # One pass over the findings: each asks for the policies of all packages ("") and, with a package, for those of its own.
    own = F.concat(F.lit("="), F.col("package_name"))
    asked = f.withColumn("_for", F.explode(F.array_compact(F.array(F.lit(""), own))))
    rules = scoped.select("scan_id", "policy_id", "conditions")
    general = rules.filter(~has_patterns(F.col("conditions"))).withColumn("_for", F.lit(""))
    special = rules.join(hits, ["scan_id", "policy_id"]).select(*rules.columns, F.concat(F.lit("="), F.col("package_name")).alias("_for"))
    joined = salted_join(asked, general.unionByName(special), ["scan_id", "_for"]).filter(matches(F.col("conditions")))
    return joined.select("scan_id", "policy_id", *(["idx"] if with_index else []))


def match_positions(found: DataFrame, size: int = 10_000) -> DataFrame:
    """Matched positions as sorted arrays, in parts of at most ``size`` positions
    of a scan, so no array grows with the scan."""
    return (
        found.groupBy("scan_id", "policy_id", F.floor(F.col("idx") / size).alias("part"))
        .agg(F.array_sort(F.collect_list("idx")).alias("matched_indices"))
    )


def evaluate_policies(scoped: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per policy and scan: matched count and status; policies without
    a match are kept.  The counts are reduced before they are shuffled."""
    counted = policy_matches(scoped, findings, [], with_index=False).groupBy("scan_id", "policy_id").agg(F.count("*").alias("_n"))
    out = scoped.select("scan_id", "policy_id", F.col("name").alias("policy_name"), "action").join(
        counted, ["scan_id", "policy_id"], "left"
    )
    count = F.coalesce("_n", F.lit(0))
    return out.select(
        "scan_id", "policy_id", "policy_name", "action",
        F.when((F.col("action") != "ignore") & (count > 0), "violated").otherwise("passed").alias("status"),
        count.alias("matched_count"),
    )


def scan_verdict(scans: DataFrame, evaluations: DataFrame) -> DataFrame:
    """NULL without policies; violated if a block or warn policy is violated."""
    v = evaluations.groupBy("scan_id").agg(
        F.bool_or((F.col("status") == "violated") & F.col("action").isin("block", "warn")).alias("_bad")
    )
    return scans.select("scan_id").join(v, "scan_id", "left").select(
        "scan_id", F.when(F.col("_bad"), "violated").when(~F.col("_bad"), "passed").alias("policy_status")
    )
