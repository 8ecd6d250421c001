"""Dashboard queries: rollups, trends, scores, top lists, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import registries as reg
from ..functions.text import severity_rank
from .policies import without_markers
from .ranking import top_per_group


def _count_if(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def severity_counts() -> list[Column]:
    """total, critical, warning and info; anything else counts as info."""
    s = F.col("severity")
    return [
        F.count("*").alias("total"),
        _count_if(s == "critical", "critical"),
        _count_if(s == "warning", "warning"),
        _count_if(~s.isin("critical", "warning"), "info"),
    ]


def severity_rollup(findings: DataFrame, keys=("scan_id",)) -> DataFrame:
    return without_markers(findings).groupBy(*keys).agg(*severity_counts())


def severity_rollup_levels(findings: DataFrame, *levels: str) -> DataFrame:
    """Subtotals along a hierarchy and a grand total; NULL marks a subtotal."""
    return without_markers(findings).rollup(*levels).agg(*severity_counts())


def latest_completed(scans: DataFrame, recent: int | None = None, order=("created_at", "scan_id")) -> DataFrame:
    """Newest completed scan per project, optionally among the newest ``recent`` scans of each project."""
    newest = [F.desc(o) for o in order]
    base = scans if recent is None else top_per_group(scans, ["project_id"], newest, recent).drop("rn")
    return top_per_group(base.filter(F.col("status") == "completed"), ["project_id"], newest, 1).drop("rn")


def security_score(criticals: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - criticals * 10 - warnings * 3)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def portfolio(latest: DataFrame, keys=()) -> DataFrame:
    sums = latest.groupBy(*keys).agg(
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical"),
        F.coalesce(F.sum("warning_count"), F.lit(0)).alias("warning"),
        F.coalesce(F.sum("info_count"), F.lit(0)).alias("info"),
    )
    score = security_score(F.col("critical"), F.col("warning"))
    return sums.withColumns(
        {"total": F.col("critical") + F.col("warning") + F.col("info"), "score": score, "grade": grade(score)}
    )


def trend(scans: DataFrame, recent: int | None = None, order=("created_at", "scan_id"), keys=()) -> DataFrame:
    """Counts per day over completed scans; with keys, optionally those among the newest ``recent`` of each."""
    newest = [F.desc(o) for o in order]
    base = top_per_group(scans, list(keys), newest, recent).drop("rn") if keys and recent else scans
    day = F.to_date("created_at").alias("day")
    return base.filter(F.col("status") == "completed").groupBy(*keys, day).agg(
        F.sum("critical_count").alias("critical"), F.sum("warning_count").alias("warning"), F.sum("info_count").alias("info"),
        F.sum(F.col("critical_count") + F.col("warning_count") + F.col("info_count")).alias("total"),
    )


def recent_scans(scans: DataFrame, projects: DataFrame, n: int = 10) -> DataFrame:
    top = scans.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(n)
    return top.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id")


def findings_of_user(findings: DataFrame, scans: DataFrame, projects: DataFrame, user) -> DataFrame:
    """Findings of a user's projects, with the project name."""
    p = projects.filter(F.col("user_id") == user).select("project_id", F.col("name").alias("project_name"))
    s = scans.select("scan_id", "project_id").join(p, "project_id")
    return without_markers(findings).join(s, "scan_id")


def recent_findings(findings: DataFrame, n: int, order=("created_at", "seq")) -> DataFrame:
    return findings.orderBy(*[F.desc(o) for o in order]).limit(n)


def ordered_findings(findings: DataFrame, by_rank: bool = False, tie: str = "seq") -> DataFrame:
    """Position of a finding in its scan's listing order (text order of severity
    by default, rank order on request)."""
    from .ranking import grouped_index

    f = findings.withColumn("_sev", severity_rank(F.col("severity")) if by_rank else F.col("severity"))
    return grouped_index(f, "scan_id", ["_sev", "file_path", "line", tie], "position").drop("_sev")


def files_with_findings(findings: DataFrame, approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct("file_path") if approximate else F.count_distinct("file_path")
    return without_markers(findings).groupBy("scan_id").agg(n.alias("files"))


def source_of(rule: Column) -> Column:
    """Dependency findings are ``sca``; all else, licences included, is ``sast``."""
    return F.when(rule.startswith("SCA-"), "sca").otherwise("sast")


def facets(findings: DataFrame) -> DataFrame:
    """Counts for every tab and severity at once (NULL = all)."""
    f = without_markers(findings).withColumn("source", source_of(F.col("rule_id")))
    return f.cube("source", "severity").agg(
        F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.count_distinct("rule_name").alias("rules")
    )


def is_exploitable() -> Column:
    return (F.col("severity") == "critical") & (F.col("confidence") == "high")


def search_findings(
    findings: DataFrame, *, tab=None, severities=(), files=(), rules=(), exploitable=False, hide_dev=False, text=None
) -> DataFrame:
    f = without_markers(findings)
    if tab is not None:
        f = f.filter(source_of(F.col("rule_id")) == tab)
    if exploitable:
        f = f.filter(is_exploitable())
    for column, values in (("severity", severities), ("file_path", files), ("rule_name", rules)):
        if values:
            f = f.filter(F.col(column).isin(list(values)))
    if hide_dev:
        f = f.filter(~(F.col("rule_id").startswith("SCA-") & F.contains("rule_name", F.lit("(dev)"))))
    if text:
        q = F.lit(text.lower())
        cols = ("message", "rule_name", "file_path", "snippet", "cwe")
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
        f = f.filter(hit)
    return f


def exploitable_count(findings: DataFrame) -> DataFrame:
    return without_markers(findings).groupBy("scan_id").agg(F.count_if(is_exploitable()).alias("exploitable"))


def group_by_file(findings: DataFrame, tie: str = "seq") -> DataFrame:
    """Findings numbered within their scan and file, as rows; code findings only."""
    f = without_markers(findings).filter(~F.col("rule_id").startswith("SCA-"))
    place = F.row_number().over(Window.partitionBy("scan_id", "file_path").orderBy("line", tie, "rule_id", "severity"))
    item = F.concat(F.col("line").cast("string"), F.lit(":"), "rule_id", F.lit(":"), "severity")
    return f.select("scan_id", "file_path", (place - 1).alias("pos"), item.alias("item"))


def package_of(rule_name: Column) -> Column:
    stripped = F.regexp_replace(rule_name, "^Vulnerable dependency: ", "")
    at = F.instr(stripped, " (dev)")
    return F.when(at > 0, F.concat(stripped.substr(F.lit(1), at - 1), stripped.substr(at + 6, F.length(stripped)))).otherwise(stripped)


def package_rollup(findings: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Per vulnerable package: findings, versions, worst severity, ecosystem, dev flag."""
    f = without_markers(findings).filter(F.col("rule_id").startswith("SCA-"))
    f = f.withColumns(
        {
            "package": package_of(F.col("rule_name")),
            "_version": F.nullif(F.regexp_extract("message", r"^[^@]+@([^\s(]+)", 1), F.lit("")),
            "_eco": F.nullif(F.regexp_extract("snippet", r"^\[([^\]]+)\]", 1), F.lit("")),
        }
    )
    return f.groupBy(*keys, "package").agg(
        F.count("*").alias("findings"),
        F.array_sort(F.collect_set("_version")).alias("versions"),
        F.element_at(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), F.min(severity_rank(F.col("severity"))) + 1).alias("worst"),
        F.min("_eco").alias("ecosystem"),
        F.bool_or(F.contains("rule_name", F.lit("(dev)"))).alias("dev"),
    )


def unread_notifications(notifications: DataFrame, n: int = 20) -> DataFrame:
    """Unread among the newest n, per user."""
    top = top_per_group(notifications, ["user_id"], [F.desc("created_at"), F.desc("notification_id")], n)
    return top.groupBy("user_id").agg(F.count("*").alias("shown"), F.count_if(F.col("read_at").isNull()).alias("unread"))


def latest_scan_of_repo(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Per project name: its newest project, and that project's newest scan of any status."""
    newest = projects.groupBy("name").agg(F.max(F.struct("created_at", "project_id")).alias("p"))
    named = newest.select("name", F.col("p.project_id").alias("project_id"))
    last = scans.groupBy("project_id").agg(F.max(F.struct("created_at", "scan_id", "status")).alias("s"))
    return named.join(last, "project_id").select("name", "project_id", F.col("s.scan_id").alias("scan_id"), F.col("s.status").alias("status"))


def visible_to(rows: DataFrame, scans: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of scans whose project belongs to one of the users."""
    p = projects.join(users.select("user_id"), "user_id", "left_semi")
    s = scans.join(p.select("project_id"), "project_id", "left_semi")
    return rows.join(s.select("scan_id"), "scan_id", "left_semi")


def cascade_delete(projects: DataFrame, scans: DataFrame, findings: DataFrame, deleted: DataFrame):
    """Survivors of deleting projects: (projects, scans, findings)."""
    gone = deleted.select("project_id").distinct()
    dead_scans = scans.join(gone, "project_id", "left_semi").select("scan_id")
    return (
        projects.join(gone, "project_id", "left_anti"),
        scans.join(gone, "project_id", "left_anti"),
        findings.join(dead_scans, "scan_id", "left_anti"),
    )


def find_or_create_projects(projects: DataFrame, requested: DataFrame) -> DataFrame:
    """Merge by (user, name): existing rows get a new ``updated_at``, others are created."""
    old = projects.groupBy("user_id", "name").agg(F.min("project_id").alias("project_id"), F.max("updated_at").alias("_old"))
    new = requested.groupBy("user_id", "name").agg(F.max("requested_at").alias("_new"))
    return old.join(new, ["user_id", "name"], "full_outer").select(
        "user_id", "name", "project_id", F.coalesce("_new", "_old").alias("updated_at"), F.col("project_id").isNull().alias("created")
    )


def due_projects(projects: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Daily schedules always, weekly ones on Sundays; all of them, or the first ``limit`` by key."""
    s = F.col("scan_schedule")
    due = projects.filter(
        s.isNotNull() & (s != "none") & ((s == "daily") | ((s == "weekly") & (F.dayofweek(as_of) == 1)))
    )
    return due if limit is None else due.orderBy("project_id").limit(limit)


def running_check(scans: DataFrame, as_of: Column, minutes: int = reg.STUCK_MINUTES) -> DataFrame:
    """Per project: skip (a scan runs), restart (it is stuck) or start."""
    last = scans.groupBy("project_id").agg(F.max(F.struct("created_at", "scan_id", "status")).alias("l"))
    age = (F.unix_millis(as_of) - F.unix_millis("l.created_at")) / 60000.0
    return last.select(
        "project_id",
        F.col("l.scan_id").alias("scan_id"),
        F.when(F.col("l.status") != "running", "start").when(age < minutes, "skip").otherwise("restart").alias("decision"),
    )


def fail_stuck(scans: DataFrame, as_of: Column, minutes: int = reg.STUCK_MINUTES) -> DataFrame:
    """Mark the running scans of projects whose newest scan is stuck."""
    stuck = running_check(scans, as_of, minutes).filter(F.col("decision") == "restart").select("project_id", F.lit(True).alias("_s"))
    return scans.join(stuck, "project_id", "left").withColumn(
        "status", F.when((F.col("status") == "running") & F.coalesce("_s", F.lit(False)), "failed").otherwise(F.col("status"))
    ).drop("_s")


def duration_ms(started: str = "created_at", ended: str = "completed_at") -> Column:
    return F.unix_millis(ended) - F.unix_millis(started)


def fix_first(findings: DataFrame, n: int = 5, tie: str = "seq") -> DataFrame:
    """Critical findings and confident warnings, first n per scan in listing order."""
    f = without_markers(findings).filter(
        (F.col("severity") == "critical") | ((F.col("severity") == "warning") & (F.col("confidence") == "high"))
    )
    return top_per_group(f, ["scan_id"], ["severity", "file_path", "line", tie], n)


def license_alerts(findings: DataFrame, n: int = 5, tie: str = "seq") -> DataFrame:
    f = findings.filter(F.col("rule_id").startswith("LICENSE-"))
    top = top_per_group(f, ["scan_id"], [tie], n)
    name = F.regexp_replace("rule_name", "^Copyleft license: ", "")
    return top.select(
        "scan_id", "rn", "severity", F.regexp_replace(name, r" \(dev\)", "").alias("package"),
        F.regexp_extract("snippet", "License: (.+)$", 1).alias("license"),
    )


def valid_webhook(url: Column) -> Column:
    """https only, and a host on the list (one family also needs its path)."""
    scheme, host, path = (F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH"))
    host = F.lower(host)
    return F.coalesce(
        (F.lower(scheme) == "https")
        & (host.isin(*reg.WEBHOOK_HOSTS) | (host.isin(*reg.WEBHOOK_HOSTS_WITH_PREFIX) & path.startswith(reg.WEBHOOK_PREFIX))),
        F.lit(False),
    )


def recent_activity(findings: DataFrame, fetched: int = 10, shown: int = 8, order=("created_at", "seq")) -> DataFrame:
    newest = [F.desc(o) for o in order]
    return findings.orderBy(*newest).limit(fetched).orderBy(*newest).limit(shown)


def marker_metrics(findings: DataFrame) -> DataFrame:
    """Marker rows as columns: package count and whether the check was skipped."""
    return findings.filter(F.col("rule_id").isin(*reg.MARKER_RULES)).groupBy("scan_id").agg(
        F.max(F.when(F.col("rule_id") == "SCA-META", F.regexp_extract("message", r"^\s*([0-9]+)", 1).try_cast("int"))).alias("dep_count"),
        F.bool_or(F.col("rule_id") == "SCA-SKIPPED").alias("skipped"),
    )
