"""Documents and reports built from findings and dependencies.

A document covers one scan.  It is a table of text fragments (scan_id, place,
text) that make the document when they are put together in the order of place:
a head, one fragment per finding or component, and a tail.  So no array or
string grows with a scan, and a document has one form at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import registries as reg
from ..functions.text import severity_rank
from .policies import without_markers
from .ranking import grouped_index, top_per_group
from .reports import severity_counts

SARIF_SCHEMA_URI = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
TOOL = "codeassay"
#: Files that one folder may get from one append.
FILES = 4
#: Place of the fragment that closes a document.
TAIL = (1 << 63) - 1


# --------------------------------------------------------------- findings table
def findings_table(findings: DataFrame) -> DataFrame:
    """Rows for the findings table: NULL for empty optional texts, default confidence."""
    empty_null = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    default = F.when(F.col("rule_id").startswith("SCA-") | F.col("rule_id").startswith("LICENSE-"), "high").otherwise("medium")
    return findings.select(
        "scan_id", "rule_id", "rule_name", "severity", F.coalesce("confidence", default).alias("confidence"), "message",
        "file_path", "line", "column", empty_null("snippet"), empty_null("cwe"), empty_null("owasp"), empty_null("suggestion"),
    )


def write_findings(findings: DataFrame, path: str, partition_by: str = "repo", mode: str = "append") -> None:
    """Append findings; rows of a folder meet in a few tasks (a large one in up to ``FILES``), so it gets few files."""
    salt = F.pmod(F.xxhash64("file_path", "line"), F.lit(FILES))
    findings.repartition(F.col(partition_by), salt).write.mode(mode).partitionBy(partition_by).parquet(path)


def to_json_rows(results: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return results.select(F.to_json(F.struct("*")).alias("value"))


# ------------------------------------------------------------------------ SARIF
def level_of(severity: Column) -> Column:
    return F.when(severity == "critical", "error").when(severity == "warning", "warning").otherwise("note")


def sarif_result() -> Column:
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        level_of(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"),
                    F.struct(
                        F.col("line").alias("startLine"), F.col("column").alias("startColumn"),
                        F.struct(F.col("snippet").alias("text")).alias("snippet"),
                    ).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.array(F.struct(F.struct(F.col("suggestion").alias("text")).alias("description"))).alias("fixes"),
    )


def sarif_rule() -> Column:
    return F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_name").alias("name"),
        F.struct(F.col("message").alias("text")).alias("shortDescription"),
        F.concat(
            F.lit("https://cwe.mitre.org/data/definitions/"), F.regexp_replace("cwe", "^CWE-", ""), F.lit(".html")
        ).alias("helpUri"),
        F.struct("cwe", "owasp").alias("properties"),
    )


def _every(found: DataFrame, scans: DataFrame | None) -> DataFrame:
    """``found`` (a row a scan) with the scans that it lacks, their other columns null."""
    if scans is None:
        return found
    return found.join(scans.select("scan_id").distinct(), "scan_id", "full")


def to_sarif(findings: DataFrame, order: list[str], scans: DataFrame | None = None) -> DataFrame:
    """Fragments of SARIF 2.1.0 documents, one document for each scan with a finding and for each of ``scans``.

    A scan without findings has a document without rules and results.  The head lists the rules once per scan (at most as many as the catalog
    has), each by its first finding, in order of appearance; ``place`` of a
    result is its position in the scan.
    """
    f = grouped_index(findings, "scan_id", order)
    results = f.select("scan_id", F.col("idx").alias("place"), F.concat(F.when(F.col("idx") > 0, ",").otherwise(""), F.to_json(sarif_result())).alias("text"))
    rules = f.groupBy("scan_id", "rule_id").agg(F.min_by(sarif_rule(), "idx").alias("u"), F.min("idx").alias("first"))
    rules = rules.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "u"))), lambda x: x["u"]).alias("rules"))
    rules = _every(rules, scans).select("scan_id", F.coalesce("rules", F.array().cast(rules.schema["rules"].dataType)).alias("rules"))
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit("0.1.0").alias("version"), F.col("rules").alias("rules"))
    doc = F.struct(
        F.lit(SARIF_SCHEMA_URI).alias("$schema"),
        F.lit("2.1.0").alias("version"),
        F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), F.array().cast("array<string>").alias("results"))).alias("runs"),
    )
    head = rules.select("scan_id", F.lit(-1).cast("bigint").alias("place"), F.regexp_replace(F.to_json(doc), r"\]\}\]\}$", "").alias("text"))
    tail = rules.select("scan_id", F.lit(TAIL).alias("place"), F.lit(SARIF_END).alias("text"))
    return results.unionByName(head).unionByName(tail)


SARIF_END = "]}]}"
SARIF_READ = """STRUCT<runs:ARRAY<STRUCT<tool:STRUCT<driver:STRUCT<rules:ARRAY<STRUCT<id:STRING,name:STRING,helpUri:STRING>>>>>>>"""
RESULT_READ = """STRUCT<ruleId:STRING,level:STRING,locations:ARRAY<STRUCT<physicalLocation:STRUCT<artifactLocation:STRUCT<uri:STRING>,
region:STRUCT<startLine:INT,startColumn:INT>>>>>"""


def read_sarif_results(fragments: DataFrame) -> DataFrame:
    """(scan_id, pos, r): results of documents; what can't be read is null."""
    inner = fragments.filter((F.col("place") >= 0) & (F.col("place") < TAIL))
    return inner.select("scan_id", F.col("place").alias("pos"), F.from_json(F.ltrim("text", F.lit(",")), RESULT_READ).alias("r"))


def read_sarif_rules(fragments: DataFrame) -> DataFrame:
    """(scan_id, pos, r): rules of documents."""
    heads = fragments.filter("place = -1").select("scan_id", F.from_json(F.concat("text", F.lit(SARIF_END)), SARIF_READ).alias("doc"))
    return heads.select("scan_id", F.posexplode(F.col("doc.runs")[0]["tool"]["driver"]["rules"]).alias("pos", "r"))


def sarif_summary(fragments: DataFrame) -> DataFrame:
    """Counts read back from documents, zeros for a document without results."""
    result = F.col("place") >= 0
    read = fragments.filter(F.col("place") < TAIL).select("scan_id", result.alias("result"), F.when(result, F.from_json(F.ltrim("text", F.lit(",")), RESULT_READ)["level"]).alias("level"))
    level, result = F.coalesce("level", F.lit("")), F.col("result")
    return read.groupBy("scan_id").agg(
        F.count_if(result).alias("total"), F.count_if(result & (level == "error")).alias("critical"), F.count_if(result & (level == "warning")).alias("warning"),
        F.count_if(result & ~level.isin("error", "warning")).alias("info"),
    )


# ---------------------------------------------------------------- text reports
def summary(results_count: DataFrame, findings: DataFrame) -> DataFrame:
    """(scan_id, files, critical, warning, info): one line per scan; scans without findings are kept."""
    counts = findings.groupBy("scan_id").agg(*severity_counts())
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return results_count.join(counts, "scan_id", "left").select("scan_id", "files", zero("critical"), zero("warning"), zero("info"))


def summary_lines(findings: DataFrame) -> DataFrame:
    """The listing below the summary, one text per finding."""
    return findings.select(
        "scan_id", "file_path", "line",
        F.format_string("[%s] Line %d:%d %s", F.upper("severity"), F.col("line"), F.col("column"), F.col("message")).alias("text"),
    )


def gate(findings: DataFrame, threshold: str = "critical") -> DataFrame:
    """Per scan: does any finding reach the threshold?  ``none`` never fails."""
    if threshold == "none":
        return findings.groupBy("scan_id").agg(F.lit(False).alias("failed"))
    limit = {"critical": 0, "warning": 1, "info": 2}[threshold]
    return findings.groupBy("scan_id").agg(F.bool_or(severity_rank(F.col("severity")) <= limit).alias("failed"))


def pull_request_report(findings: DataFrame, order: list[str], link: str = "/scans/") -> DataFrame:
    """(scan_id, body): counts, the split by source and the first five per severity."""
    f = without_markers(findings)
    counts = f.groupBy("scan_id").agg(
        *severity_counts(), F.count_if(F.col("rule_id").startswith("SCA-")).alias("sca")
    )
    listed = top_per_group(f.filter(F.col("severity").isin("critical", "warning")), ["scan_id", "severity"], order, 5)
    place = F.concat(F.lit(" in `"), "file_path", F.lit(":"), F.col("line").cast("string"), F.lit("`"))
    text = F.when(F.col("severity") == "critical", F.concat(F.lit("- **"), "rule_name", F.lit("**"), place)).otherwise(
        F.concat(F.lit("- "), "rule_name", place)
    )
    lines = listed.groupBy("scan_id").agg(
        *[
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("rn", text.alias("t"))))), lambda x: x["t"]
                ),
                "\n",
            ).alias(f"{s}_list")
            for s in ("critical", "warning")
        ]
    )
    n = F.col("total")
    section = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"### {title}\n"), c, F.lit("\n\n"))).otherwise("")
    body = F.concat(
        F.lit("## Security report\n\n"),
        F.format_string("**%d vulnerabilities** found (%d critical, %d warning, %d info)", n, "critical", "warning", "info"),
        F.when((F.col("sca") > 0) & (n - F.col("sca") > 0), F.format_string(" - SAST: %d, SCA: %d", n - F.col("sca"), "sca")).otherwise(""),
        F.lit("\n\n"),
        section("Critical", F.col("critical_list")),
        section("Warning", F.col("warning_list")),
        F.when(n > 10, F.format_string("*...and %d more*\n\n", n - 10)).otherwise(""),
        F.lit("[View full report]("), F.lit(link), F.col("scan_id").cast("string"), F.lit(")"),
    )
    return counts.join(lines, "scan_id", "left").select("scan_id", body.alias("body"))


def empty_report(scans: DataFrame, link: str = "/scans/") -> DataFrame:
    """Body for scans without findings."""
    return scans.select(
        "scan_id",
        F.concat(F.lit("## Security report\n\nNo vulnerabilities found.\n\n[View full report]("), F.lit(link), F.col("scan_id").cast("string"), F.lit(")")).alias("body"),
    )


def scan_notifications(scans: DataFrame, projects: DataFrame, kind: str = "scheduled_scan") -> DataFrame:
    """One notice per completed scan."""
    total = F.col("critical_count") + F.col("warning_count") + F.col("info_count")
    done = scans.filter(F.col("status") == "completed").join(projects.select("project_id", "user_id", "name"), "project_id")
    return done.select(
        "scan_id", "user_id", F.lit(kind).alias("type"), F.concat(F.lit("Scheduled scan: "), "name").alias("title"),
        F.when(total > 0, F.format_string("Found %d vulnerabilities (%d critical)", total, "critical_count"))
        .otherwise("No vulnerabilities found")
        .alias("message"),
        F.concat(F.lit("/scans/"), F.col("scan_id").cast("string")).alias("link"),
    )


def audit_digest(findings: DataFrame, tie: str = "seq") -> DataFrame:
    """(scan_id, rn, entry): all findings of a scan by severity text, numbered; a digest is its entries in order."""
    entry = F.concat(
        F.format_string("%d. [%s] %s - %s:%d\n   %s", "rn", "severity", "rule_name", "file_path", "line", "message"),
        F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n   Code: "), "snippet")).otherwise(""),
    )
    return grouped_index(findings, "scan_id", ["severity", tie]).withColumn("rn", F.col("idx") + 1).select("scan_id", "rn", entry.alias("entry"))


def context_excerpt(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Numbered lines around findings that come from elsewhere (joins the corpus;
    ``scan(..., excerpt=True)`` gives the same without a join)."""
    from .lines import excerpt
    from ..functions.text import lines_of

    wanted = findings.groupBy("repo", "file_path").agg(F.collect_set("line").alias("wanted"))
    files = corpus.select("repo", F.col("path").alias("file_path"), lines_of(F.col("content")).alias("_l"))
    cut = F.transform("wanted", lambda n: F.struct(n.alias("line"), excerpt(F.col("_l"), n).alias("excerpt")))
    parts = files.join(wanted, ["repo", "file_path"]).select("repo", "file_path", F.explode(cut).alias("x"))
    return parts.select("repo", "file_path", "x.line", "x.excerpt")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, key: str = "seq") -> DataFrame:
    """Keep findings judged real (the default) and take over adjusted severities."""
    v = verdicts.select(key, F.col("is_real").alias("_real"), F.col("adjusted_severity").alias("_sev"))
    return (
        findings.join(v, key, "left")
        .filter(F.coalesce("_real", F.lit(True)))
        .withColumn("severity", F.coalesce("_sev", "severity"))
        .drop("_real", "_sev")
    )


# ------------------------------------------------------------------------- SBOM
def purl(ecosystem: Column, name: Column, version: Column, fallback: str = "generic") -> Column:
    scoped = F.when(name.startswith("@"), F.concat(F.lit("%40"), F.substr(name, F.lit(2)))).otherwise(name)
    at = F.lit("@")
    npm = F.concat(F.lit("pkg:npm/"), scoped, at, version)
    return (
        F.when(ecosystem == "npm", npm)
        .when(ecosystem == "PyPI", F.concat(F.lit("pkg:pypi/"), F.lower(name), at, version))
        .when(ecosystem == "Go", F.concat(F.lit("pkg:golang/"), name, at, version))
        .when(ecosystem == "crates.io", F.concat(F.lit("pkg:cargo/"), name, at, version))
        .otherwise(npm if fallback == "npm" else F.concat(F.lit("pkg:generic/"), name, at, version))
    )


def component() -> Column:
    p = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    return F.struct(
        F.lit("library").alias("type"), p.alias("bom-ref"), "name", "version", p.alias("purl"),
        F.when(F.coalesce("license", F.lit("")) != "", F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license")))).alias("licenses"),
        F.when(F.col("dev"), F.lit("excluded")).alias("scope"),
    )


def to_sbom(dependencies: DataFrame, order: list[str], project: Column | None = None, scans: DataFrame | None = None) -> DataFrame:
    """Fragments of CycloneDX 1.5 documents with a component per dependency.

    Each of ``scans`` has a document, without components if it has no
    dependencies; such a document is named by its scan.
    """
    d = grouped_index(dependencies, "scan_id", order)
    each = d.select("scan_id", F.col("idx").alias("place"), F.concat(F.when(F.col("idx") > 0, ",").otherwise(""), F.to_json(component())).alias("text"))
    # A text taken along in the aggregate would make it sort all rows.
    named = dependencies.select("scan_id").distinct().withColumn("_name", F.col("scan_id").cast("string")) if project is None else dependencies.groupBy("scan_id").agg(F.min(project).alias("_name"))
    scans = _every(named, scans).select("scan_id", F.coalesce("_name", F.col("scan_id").cast("string")).alias("_name"))
    head = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"),
        F.concat(F.lit("urn:uuid:"), F.uuid()).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.array(F.struct(F.lit(TOOL).alias("vendor"), F.lit(TOOL).alias("name"), F.lit("1.0.0").alias("version"))).alias("tools"),
            F.struct(F.lit("application").alias("type"), F.col("_name").alias("name")).alias("component"),
        ).alias("metadata"),
    )
    begin = F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"components":['))
    heads = scans.select("scan_id", F.lit(-1).cast("bigint").alias("place"), begin.alias("text"))
    tails = scans.select("scan_id", F.lit(TAIL).alias("place"), F.lit("]}").alias("text"))
    return each.unionByName(heads).unionByName(tails)


def sbom_summary(fragments: DataFrame) -> DataFrame:
    """(scan_id, components): the size of each document."""
    return fragments.groupBy("scan_id").agg(F.count_if((F.col("place") >= 0) & (F.col("place") < TAIL)).alias("components"))


COMPONENT_READ = """STRUCT<type:STRING, `bom-ref`:STRING, name:STRING, version:STRING, purl:STRING, licenses:ARRAY<STRUCT<license:STRUCT<id:STRING>>>, scope:STRING>"""


def read_sbom(fragments: DataFrame) -> DataFrame:
    """(scan_id, pos, name, version, purl, scope, license) of all components."""
    inner = fragments.filter((F.col("place") >= 0) & (F.col("place") < TAIL))
    c = inner.select("scan_id", F.col("place").alias("pos"), F.from_json(F.ltrim("text", F.lit(",")), COMPONENT_READ).alias("c"))
    return c.select("scan_id", "pos", "c.name", "c.version", "c.purl", "c.scope", F.col("c.licenses")[0]["license"]["id"].alias("license"))


# ------------------------------------------------------------------ cache keys
def snippet_fingerprint(snippet: Column) -> Column:
    normal = F.regexp_replace(F.regexp_replace(snippet, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(F.coalesce(normal, F.lit("")) == "", "no-snippet").otherwise(F.substring(F.sha2(normal, 256), 1, 16))


def explain_key(rule: Column, snippet: Column, language: Column) -> Column:
    return F.concat(F.lit("explain:"), rule, F.lit(":"), snippet_fingerprint(snippet), F.lit(":"), language)


def fix_key(rule: Column, snippet: Column) -> Column:
    return F.concat(F.lit("fix:"), rule, F.lit(":"), snippet_fingerprint(snippet))


def work_units(findings: DataFrame, language: str = "en") -> DataFrame:
    """One unit of explanation work per key, with the number of findings it serves."""
    return findings.groupBy(explain_key(F.col("rule_name"), F.col("snippet"), F.lit(language)).alias("cache_key")).agg(
        F.count("*").alias("findings")
    )


def cache_misses(units: DataFrame, cache: DataFrame) -> DataFrame:
    return units.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge by key; the newest entry wins."""
    both = cache.select("cache_key", "response", "created_at").unionByName(fresh.select("cache_key", "response", "created_at"))
    return both.groupBy("cache_key").agg(F.max(F.struct("created_at", "response")).alias("x")).select(
        "cache_key", F.col("x.response").alias("response"), F.col("x.created_at").alias("created_at")
    )


def live_entries(cache: DataFrame, as_of: Column, ttl_seconds: int, capacity: int | None = None) -> DataFrame:
    """Entries younger than the limit; with a capacity, the newest ones of those."""
    live = cache.filter(F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(F.col("created_at").cast("timestamp")) <= ttl_seconds * 1000)
    return live if capacity is None else live.orderBy(F.desc("created_at"), "cache_key").limit(capacity)
