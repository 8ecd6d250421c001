"""Registered queries: dashboard and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import scratch_path
from ..operators import reports as rp, sketches as sk
from ..sources import derived as d, oracle_views as v

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


REAL = "rule_id NOT IN ('SCA-META', 'SCA-SKIPPED')"
F_ = f"WITH {v.findings()}"
S_ = f"WITH {v.scans()}, {v.projects()}"
ALL = f"WITH {v.findings()}, {v.scans()}, {v.projects()}"
COUNTS = "count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity NOT IN ('critical', 'warning')) AS info"
ORDER3 = ("created_at", "seq", "scan_id")
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"


@query("severity_rollup", f"{F_} SELECT scan_id, {COUNTS} FROM findings WHERE {REAL} GROUP BY 1")
def severity_rollup(spark, sf):
    return rp.severity_rollup(d.findings(spark, sf))


@query(
    "severity_rollup_levels",
    f"{ALL} SELECT project_id, scan_id, {COUNTS} FROM findings JOIN scans USING (scan_id) WHERE {REAL} GROUP BY ROLLUP (project_id, scan_id)",
)
def severity_rollup_levels(spark, sf):
    f = d.findings(spark, sf).join(d.scans(spark, sf).select("scan_id", "project_id"), "scan_id")
    return rp.severity_rollup_levels(f, "project_id", "scan_id")


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) AS rn FROM scans WHERE status = 'completed') WHERE rn = 1)"


@query("latest_completed_scan", f"{S_}, {LATEST} SELECT project_id, scan_id, created_at, critical_count FROM latest")
def latest_completed_scan(spark, sf):
    return rp.latest_completed(d.scans(spark, sf)).select("project_id", "scan_id", "created_at", "critical_count")


@query(
    "latest_completed_scan_recent",
    f"""{S_}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) AS k FROM scans)
    SELECT project_id, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY k) AS rn FROM r WHERE k <= 3 AND status = 'completed') WHERE rn = 1""",
)
def latest_completed_scan_recent(spark, sf):
    return rp.latest_completed(d.scans(spark, sf), recent=3).select("project_id", "scan_id")


@query(
    "portfolio_score",
    f"""{S_}, {LATEST}, p AS (SELECT sum(critical_count) AS critical, sum(warning_count) AS warning, sum(info_count) AS info FROM latest),
    s AS (SELECT *, critical + warning + info AS total, greatest(0, 100 - critical * 10 - warning * 3) AS score FROM p) SELECT *, {GRADE} AS grade FROM s""",
)
def portfolio_score(spark, sf):
    return rp.portfolio(rp.latest_completed(d.scans(spark, sf)))


@query(
    "project_scores",
    f"""{S_}, {LATEST}, p AS (SELECT project_id, sum(critical_count) AS critical, sum(warning_count) AS warning, sum(info_count) AS info FROM latest GROUP BY 1),
    s AS (SELECT *, critical + warning + info AS total, greatest(0, 100 - critical * 10 - warning * 3) AS score FROM p) SELECT *, {GRADE} AS grade FROM s""",
)
def project_scores(spark, sf):
    return rp.portfolio(rp.latest_completed(d.scans(spark, sf)), ["project_id"])


TREND = "sum(critical_count) AS critical, sum(warning_count) AS warning, sum(info_count) AS info, sum(critical_count + warning_count + info_count) AS total"


@query(
    "trend_recent",
    f"{S_} SELECT CAST(created_at AS DATE) AS day, {TREND} FROM scans WHERE status = 'completed' GROUP BY 1",
)
def trend_recent(spark, sf):
    return rp.trend(d.scans(spark, sf))


@query(
    "trend_per_project",
    f"""{S_}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) AS rn FROM scans) WHERE rn <= 10)
    SELECT project_id, CAST(created_at AS DATE) AS day, {TREND} FROM r WHERE status = 'completed' GROUP BY 1, 2""",
)
def trend_per_project(spark, sf):
    return rp.trend(d.scans(spark, sf), 10, keys=("project_id",))


@query(
    "recent_scans",
    f"{S_}, r AS (SELECT * FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 10) SELECT r.scan_id, r.project_id, r.status, p.name AS project_name FROM r JOIN projects p USING (project_id)",
)
def recent_scans(spark, sf):
    return rp.recent_scans(d.scans(spark, sf), d.projects(spark, sf)).select("scan_id", "project_id", "status", "project_name")


@query(
    "recent_findings_of_user",
    f"""{ALL} SELECT f.scan_id, f.seq, f.rule_id, p.name AS project_name FROM findings f JOIN scans s USING (scan_id) JOIN projects p USING (project_id)
    WHERE p.user_id = 3 AND {REAL} ORDER BY f.created_at DESC, f.seq DESC, f.scan_id DESC LIMIT 10""",
)
def recent_findings_of_user(spark, sf):
    f = rp.findings_of_user(d.findings(spark, sf), d.scans(spark, sf), d.projects(spark, sf), 3)
    return rp.recent_findings(f, 10, ORDER3).select("scan_id", "seq", "rule_id", "project_name")


for _rank, _name in ((False, "findings_order_text"), (True, "findings_order_rank")):
    _sev = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END" if _rank else "severity"
    QUERIES[_name] = lambda spark, sf, r=_rank: rp.ordered_findings(d.findings(spark, sf), by_rank=r).select(
        "scan_id", "seq", "severity", "position"
    )
    ORACLE[_name] = f"{F_} SELECT scan_id, seq, severity, row_number() OVER (PARTITION BY scan_id ORDER BY {_sev}, file_path, line, seq) - 1 AS position FROM findings"


@query("files_with_findings", f"{F_} SELECT scan_id, count(DISTINCT file_path) AS files FROM findings WHERE {REAL} GROUP BY 1")
def files_with_findings(spark, sf):
    return rp.files_with_findings(d.findings(spark, sf))


@query(
    "distinct_files_by_month",
    f"""{F_} SELECT date_trunc('month', created_at)::DATE AS month, count(*) AS n_rows, true AS within FROM findings WHERE {REAL} GROUP BY 1""",
)
def distinct_files_by_month(spark, sf):
    """Distinct files of scans from stored daily sketches, held against the exact counts: within five standard errors."""
    f = rp.without_markers(d.findings(spark, sf))
    path, month = scratch_path(spark, "file-sketches"), F.trunc("day", "month").alias("month")
    sketches = sk.daily_sketches(f, [F.col("scan_id"), F.col("file_path")], [])
    sk.write_days(sketches, path)
    merged = sk.distinct_of(spark.read.schema(sketches.schema).parquet(path), [month])
    exact = f.groupBy(F.trunc(F.to_date("created_at"), "month").alias("month")).agg(F.count_distinct("scan_id", "file_path").alias("n"))
    within = F.abs(F.col("n_distinct") - F.col("n")) <= 5 * sk.standard_error() * F.col("n")
    return merged.join(exact, "month").select("month", "n_rows", within.alias("within"))


@query(
    "finding_facets",
    f"""{F_} SELECT CASE WHEN rule_id LIKE 'SCA-%' THEN 'sca' ELSE 'sast' END AS source, severity, count(*) AS n, count(DISTINCT file_path) AS files,
    count(DISTINCT rule_name) AS rules FROM findings WHERE {REAL} GROUP BY CUBE (source, severity)""",
)
def finding_facets(spark, sf):
    return rp.facets(d.findings(spark, sf))


@query(
    "finding_search",
    f"""{F_} SELECT scan_id, seq FROM findings WHERE {REAL} AND severity IN ('critical', 'warning')
      AND NOT (rule_id LIKE 'SCA-%' AND contains(rule_name, '(dev)'))
      AND (contains(lower(message), 'p1') OR contains(lower(rule_name), 'p1') OR contains(lower(file_path), 'p1') OR contains(lower(snippet), 'p1') OR contains(lower(cwe), 'p1'))""",
)
def finding_search(spark, sf):
    return rp.search_findings(d.findings(spark, sf), severities=("critical", "warning"), hide_dev=True, text="P1").select("scan_id", "seq")


@query(
    "finding_search_tab",
    f"""{F_} SELECT scan_id, seq FROM findings WHERE {REAL} AND rule_id NOT LIKE 'SCA-%' AND severity = 'critical' AND confidence = 'high'
      AND file_path IN ('src/f1.js', 'src/f2.js') AND rule_name IN ('Rule SG-002', 'Rule SG-021')""",
)
def finding_search_tab(spark, sf):
    return rp.search_findings(
        d.findings(spark, sf), tab="sast", exploitable=True, files=("src/f1.js", "src/f2.js"), rules=("Rule SG-002", "Rule SG-021")
    ).select("scan_id", "seq")


@query("exploitable_count", f"{F_} SELECT scan_id, count(*) FILTER (WHERE severity = 'critical' AND confidence = 'high') AS exploitable FROM findings WHERE {REAL} GROUP BY 1")
def exploitable_count(spark, sf):
    return rp.exploitable_count(d.findings(spark, sf))


@query(
    "group_by_file",
    f"""{F_} SELECT scan_id, file_path, row_number() OVER (PARTITION BY scan_id, file_path ORDER BY line, seq) - 1 AS pos,
      line || ':' || rule_id || ':' || severity AS item FROM findings WHERE {REAL} AND rule_id NOT LIKE 'SCA-%'""",
)
def group_by_file(spark, sf):
    return rp.group_by_file(d.findings(spark, sf))


@query(
    "package_rollup",
    f"""{F_}, p AS (SELECT *, replace(replace(rule_name, 'Vulnerable dependency: ', ''), ' (dev)', '') AS package FROM findings WHERE {REAL} AND rule_id LIKE 'SCA-%')
    SELECT scan_id, package, count(*) AS findings, list_sort(list(DISTINCT regexp_extract(message, '^[^@]+@([^\\s(]+)', 1))) AS versions,
      ['critical', 'warning', 'info'][min(CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END)] AS worst,
      min(regexp_extract(snippet, '^\\[([^\\]]+)\\]', 1)) AS ecosystem, bool_or(contains(rule_name, '(dev)')) AS dev FROM p GROUP BY 1, 2""",
)
def package_rollup(spark, sf):
    return rp.package_rollup(d.findings(spark, sf))


def _notifications(spark, sf):
    e = d.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("notification_id"), "user_id", F.col("ts").alias("created_at"),
        F.when(F.col("event_type").isin("click", "view"), F.col("ts")).alias("read_at"),
    )


@query(
    "unread_notifications",
    """WITH t AS (SELECT user_id, event_type NOT IN ('click', 'view') AS unread, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, count(*) AS shown, count(*) FILTER (WHERE unread) AS unread FROM t WHERE rn <= 20 GROUP BY 1""",
)
def unread_notifications(spark, sf):
    return rp.unread_notifications(_notifications(spark, sf))


def _dated_projects(spark, sf):
    first = d.scans(spark, sf).groupBy("project_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return d.projects(spark, sf).join(first, "project_id")


DATED = "dated AS (SELECT p.*, s.a AS created_at, s.b AS updated_at FROM projects p JOIN (SELECT project_id, min(created_at) AS a, max(created_at) AS b FROM scans GROUP BY 1) s USING (project_id))"


@query(
    "latest_scan_of_repository",
    f"""{S_}, {DATED}, n AS (SELECT name, project_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, project_id DESC) AS rn FROM dated) WHERE rn = 1)
    SELECT name, project_id, scan_id, status FROM (SELECT n.name, n.project_id, s.scan_id, s.status, row_number() OVER (PARTITION BY n.project_id ORDER BY s.created_at DESC, s.scan_id DESC) AS rn
      FROM n JOIN scans s USING (project_id)) WHERE rn = 1""",
)
def latest_scan_of_repository(spark, sf):
    return rp.latest_scan_of_repo(_dated_projects(spark, sf), d.scans(spark, sf))


@query(
    "ownership_filter",
    f"""{ALL} SELECT seq, scan_id, rule_id FROM findings WHERE scan_id IN (SELECT scan_id FROM scans WHERE project_id IN (
      SELECT project_id FROM projects WHERE user_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)))""",
)
def ownership_filter(spark, sf):
    users = d.table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("user_id"))
    return rp.visible_to(d.findings(spark, sf), d.scans(spark, sf), d.projects(spark, sf), users).select("seq", "scan_id", "rule_id")


@query(
    "cascade_delete",
    f"""{ALL}, gone AS (SELECT project_id FROM projects WHERE scan_schedule IS NULL)
    SELECT 'projects' AS kind, count(*) AS n FROM projects WHERE project_id NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'scans', count(*) FROM scans WHERE project_id NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'findings', count(*) FROM findings WHERE scan_id NOT IN (SELECT scan_id FROM scans WHERE project_id IN (SELECT * FROM gone))""",
)
def cascade_delete(spark, sf):
    p = d.projects(spark, sf)
    left = rp.cascade_delete(p, d.scans(spark, sf), d.findings(spark, sf), p.filter(F.col("scan_schedule").isNull()))
    counts = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in zip(("projects", "scans", "findings"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "find_or_create_project",
    f"""{S_}, {DATED}, old AS (SELECT user_id, name, min(project_id) AS project_id, max(updated_at) AS u FROM dated GROUP BY 1, 2),
    req AS (SELECT user_id % 25 AS user_id, 'org' || (user_id % 25) || '/' || ['building', 'machinery', 'new'][event_id % 3 + 1] || '-' || (event_id % 100) AS name, max(ts) AS t FROM events GROUP BY 1, 2)
    SELECT coalesce(old.user_id, req.user_id) AS user_id, coalesce(old.name, req.name) AS name, project_id, coalesce(t, u) AS updated_at, project_id IS NULL AS created
    FROM old FULL JOIN req ON old.user_id = req.user_id AND old.name = req.name""",
)
def find_or_create_project(spark, sf):
    e = d.table(spark, sf, "events")
    u = F.col("user_id") % 25
    req = e.select(
        u.cast("int").alias("user_id"),
        F.concat(F.lit("org"), u.cast("string"), F.lit("/"), d._pick(("building", "machinery", "new"), F.col("event_id") % 3), F.lit("-"), (F.col("event_id") % 100).cast("string")).alias("name"),
        F.col("ts").cast("timestamp").alias("requested_at"),
    )
    return rp.find_or_create_projects(_dated_projects(spark, sf), req)


@query(
    "schedule_eligibility",
    f"{S_} SELECT project_id, scan_schedule FROM projects WHERE scan_schedule = 'daily' OR scan_schedule = 'weekly'",
)
def schedule_eligibility(spark, sf):
    # 7 January 2024 was a Sunday
    return rp.due_projects(d.projects(spark, sf), F.to_timestamp(F.lit("2024-01-07 06:00:00")), limit=None).select("project_id", "scan_schedule")


@query("schedule_batch", f"{S_} SELECT project_id, scan_schedule FROM projects WHERE scan_schedule = 'daily'")
def schedule_batch(spark, sf):
    return rp.due_projects(d.projects(spark, sf), F.to_timestamp(F.lit("2024-01-08 06:00:00"))).select("project_id", "scan_schedule")


AS_OF = "2001-07-31 00:10:00"
LASTRUN = "lastrun AS (SELECT project_id, arg_max(scan_id, (created_at, scan_id)) AS scan_id, arg_max(status, (created_at, scan_id)) AS status, max(created_at) AS t FROM scans GROUP BY 1)"
DECIDE = f"CASE WHEN status <> 'running' THEN 'start' WHEN epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(t) < 900000 THEN 'skip' ELSE 'restart' END"


@query("running_check", f"{S_}, {LASTRUN} SELECT project_id, scan_id, {DECIDE} AS decision FROM lastrun")
def running_check(spark, sf):
    return rp.running_check(d.scans(spark, sf), F.to_timestamp(F.lit(AS_OF)))


@query(
    "fail_stuck_scans",
    f"""{S_}, {LASTRUN}, dec AS (SELECT project_id, {DECIDE} AS decision FROM lastrun)
    SELECT CASE WHEN s.status = 'running' AND dec.decision = 'restart' THEN 'failed' ELSE s.status END AS status, count(*) AS n FROM scans s JOIN dec USING (project_id) GROUP BY 1""",
)
def fail_stuck_scans(spark, sf):
    return rp.fail_stuck(d.scans(spark, sf), F.to_timestamp(F.lit(AS_OF))).groupBy("status").agg(F.count("*").alias("n"))


@query("scan_duration", "SELECT o_orderkey AS scan_id, epoch_ms(max(CAST(l_shipdate AS TIMESTAMP))) - epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS duration_ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def scan_duration(spark, sf):
    ended = d.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id")).agg(F.max("l_shipdate").cast("timestamp").alias("completed_at"))
    return d.scans(spark, sf).join(ended, "scan_id").select("scan_id", rp.duration_ms().alias("duration_ms"))


@query(
    "fix_first",
    f"""{F_} SELECT scan_id, seq, rn FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY severity, file_path, line, seq) AS rn FROM findings
    WHERE {REAL} AND (severity = 'critical' OR (severity = 'warning' AND confidence = 'high'))) WHERE rn <= 5""",
)
def fix_first(spark, sf):
    return rp.fix_first(d.findings(spark, sf)).select("scan_id", "seq", "rn")


@query(
    "license_alerts",
    f"""{F_} SELECT scan_id, rn, severity, replace(replace(rule_name, 'Copyleft license: ', ''), ' (dev)', '') AS package, regexp_extract(snippet, 'License: (.+)$', 1) AS license
    FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS rn FROM findings WHERE rule_id LIKE 'LICENSE-%') WHERE rn <= 5""",
)
def license_alerts(spark, sf):
    return rp.license_alerts(d.findings(spark, sf))


HOSTS = (
    "https://hooks.slack.com/services/", "http://hooks.slack.com/x/", "https://discord.com/api/webhooks/", "https://discord.com/x/",
    "https://hooks.slack-gov.com/", "https://evil.example/hooks.slack.com/", "not a url ", "https://discordapp.com/api/webhooks/",
)


@query(
    "webhook_allow_list",
    f"""SELECT c_custkey AS id, c_custkey % {len(HOSTS)} IN (0, 2, 4, 7) AS valid FROM customer""",
)
def webhook_allow_list(spark, sf):
    k = F.col("c_custkey")
    url = F.concat(d._pick(HOSTS, k % len(HOSTS)), k.cast("string"))
    return d.table(spark, sf, "customer").select(k.alias("id"), rp.valid_webhook(url).alias("valid"))


@query("recent_activity", f"{F_} SELECT scan_id, seq FROM findings ORDER BY created_at DESC, seq DESC, scan_id DESC LIMIT 8")
def recent_activity(spark, sf):
    return rp.recent_activity(d.findings(spark, sf), order=ORDER3).select("scan_id", "seq")


@query(
    "marker_metrics",
    f"""{F_}, m AS (SELECT *, CASE WHEN rule_id = 'SCA-META' THEN line END AS c FROM findings WHERE NOT {REAL})
    SELECT scan_id, max(c) AS dep_count, bool_or(rule_id = 'SCA-SKIPPED') AS skipped FROM m GROUP BY 1""",
)
def marker_metrics(spark, sf):
    f = d.findings(spark, sf).withColumn("message", F.concat(F.col("line").cast("string"), F.lit(" dependencies")))
    return rp.marker_metrics(f)
