"""Registered queries: exports, reports, cache keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import scratch_path
from ..operators import exports as ex, manifests as mf, matching as ma
from ..operators.keyed import KeyedTable
from ..sources import derived as d, oracle_views as v
from ..sources.derived import RULE_POOL
from ..sources.oracle_views import sql_list
from .scan import scan, scan_results

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
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END"


@query(
    "finding_dedup",
    f"""{F_}, k AS (SELECT *, row_number() OVER (PARTITION BY scan_id, file_path, line ORDER BY {RANK}, -length(rule_id), seq) AS rn FROM findings)
    SELECT scan_id, file_path, line, rule_id, severity, seq FROM k WHERE rn = 1""",
)
def finding_dedup(spark, sf):
    f = d.findings(spark, sf).select("scan_id", "file_path", "line", "rule_id", "severity", "seq")
    return ma.dedup_findings(f, ("scan_id", "file_path", "line"))


@query(
    "rule_settings",
    f"""{F_}, cfg AS (SELECT {sql_list(RULE_POOL)}[n_nationkey % {len(RULE_POOL)} + 1] AS rule_id, min(n_nationkey) % 4 <> 0 AS enabled,
        ['critical', 'info', NULL][min(n_nationkey) % 3 + 1] AS sev FROM nation GROUP BY 1)
    SELECT f.scan_id, f.seq, f.rule_id, coalesce(cfg.sev, f.severity) AS severity FROM findings f LEFT JOIN cfg USING (rule_id) WHERE coalesce(cfg.enabled, true)""",
)
def rule_settings(spark, sf):
    n = d.table(spark, sf, "nation")
    k = F.min("n_nationkey")
    cfg = n.groupBy(d._pick(RULE_POOL, F.col("n_nationkey") % len(RULE_POOL)).alias("rule_id")).agg(
        (k % 4 != 0).alias("enabled"),
        F.when(k % 3 == 0, "critical").when(k % 3 == 1, "info").alias("severity"),
    )
    return ma.apply_config(d.findings(spark, sf), cfg).select("scan_id", "seq", "rule_id", "severity")


@query(
    "findings_table",
    f"{F_} SELECT scan_id, seq, coalesce(CASE WHEN confidence <> 'low' THEN confidence END, CASE WHEN rule_id LIKE 'SCA-%' OR rule_id LIKE 'LICENSE-%' THEN 'high' ELSE 'medium' END) AS confidence, CASE WHEN line <> 3 THEN snippet END AS snippet FROM findings",
)
def findings_table(spark, sf):
    f = d.findings(spark, sf).withColumns(
        {"confidence": F.when(F.col("confidence") != "low", F.col("confidence")), "snippet": F.when(F.col("line") == 3, "").otherwise(F.col("snippet")), "message": F.col("seq")}
    )
    return ex.findings_table(f).select("scan_id", F.col("message").alias("seq"), "confidence", "snippet")


@query("json_rows", f"{F_} SELECT scan_id, seq, rule_id, severity, file_path, line FROM findings")
def json_rows(spark, sf):
    rows = ex.to_json_rows(d.findings(spark, sf).select("scan_id", "seq", "rule_id", "severity", "file_path", "line"))
    schema = "scan_id BIGINT, seq STRING, rule_id STRING, severity STRING, file_path STRING, line INT"
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def _sarif(spark, sf):
    return ex.to_sarif(d.findings(spark, sf), ["seq"])


@query(
    "sarif_results",
    f"""{F_} SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY seq) - 1 AS pos, rule_id AS "ruleId", {LEVEL} AS level, file_path AS uri, line AS start_line, "column" AS start_column FROM findings""",
)
def sarif_results(spark, sf):
    r = ex.read_sarif_results(_sarif(spark, sf))
    loc = F.col("r.locations")[0]["physicalLocation"]
    return r.select(
        "scan_id", "pos", "r.ruleId", "r.level",
        loc["artifactLocation"]["uri"].alias("uri"), loc["region"]["startLine"].alias("start_line"), loc["region"]["startColumn"].alias("start_column"),
    )


@query(
    "sarif_rules",
    f"""{F_}, o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS k FROM findings),
    fst AS (SELECT scan_id, rule_id, min(k) AS k FROM o GROUP BY 1, 2)
    SELECT o.scan_id, row_number() OVER (PARTITION BY o.scan_id ORDER BY o.k) - 1 AS pos, o.rule_id AS id, o.rule_name AS name,
      'https://cwe.mitre.org/data/definitions/' || replace(o.cwe, 'CWE-', '') || '.html' AS "helpUri" FROM o JOIN fst USING (scan_id, rule_id, k)""",
)
def sarif_rules(spark, sf):
    r = ex.read_sarif_rules(_sarif(spark, sf))
    return r.select("scan_id", F.col("pos").cast("bigint").alias("pos"), "r.id", "r.name", "r.helpUri")


COUNTS = "count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info"


@query(
    "sarif_every_scan",
    f"""{F_}, c AS (SELECT scan_id, {COUNTS} FROM findings GROUP BY 1)
    SELECT o_orderkey AS scan_id, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info
    FROM orders LEFT JOIN c ON scan_id = o_orderkey""",
)
def sarif_every_scan(spark, sf):
    """A document for every scan, read back: scans without findings have empty ones."""
    return ex.sarif_summary(ex.to_sarif(d.findings(spark, sf), ["seq"], d.scans(spark, sf)))


@query("sarif_summary", f"{F_} SELECT scan_id, {COUNTS} FROM findings GROUP BY 1")
def sarif_summary(spark, sf):
    return ex.sarif_summary(_sarif(spark, sf))


@query(
    "summary_report",
    f"""{F_}, files AS (SELECT o_orderkey AS scan_id, CAST(o_custkey % 9 AS BIGINT) AS files FROM orders)
    SELECT f.scan_id, files, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info
    FROM files f LEFT JOIN (SELECT scan_id, {COUNTS} FROM findings GROUP BY 1) USING (scan_id)""",
)
def summary_report(spark, sf):
    files = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_id"), (F.col("o_custkey") % 9).alias("files"))
    return ex.summary(files, d.findings(spark, sf))


@query("summary_listing", f"""{F_} SELECT scan_id, file_path, line, '[' || upper(severity) || '] Line ' || line || ':' || "column" || ' ' || message AS text FROM findings""")
def summary_listing(spark, sf):
    return ex.summary_lines(d.findings(spark, sf))


for _t, _lim in (("critical", 0), ("warning", 1), ("info", 2)):
    QUERIES[f"severity_gate_{_t}"] = lambda spark, sf, t=_t: ex.gate(d.findings(spark, sf), t)
    ORACLE[f"severity_gate_{_t}"] = f"{F_} SELECT scan_id, bool_or({RANK} <= {_lim}) AS failed FROM findings GROUP BY 1"


def _listing(sev, bold):
    mark = "'- **' || rule_name || '**'" if bold else "'- ' || rule_name"
    return f"string_agg(CASE WHEN severity = '{sev}' AND rn <= 5 THEN {mark} || ' in `' || file_path || ':' || line || '`' END, chr(10) ORDER BY rn)"


@query(
    "pull_request_report",
    f"""{F_}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, severity ORDER BY seq) AS rn FROM findings WHERE {REAL}),
    g AS (SELECT scan_id, {COUNTS}, count(*) FILTER (WHERE rule_id LIKE 'SCA-%') AS sca, {_listing('critical', True)} AS cl, {_listing('warning', False)} AS wl FROM r GROUP BY 1)
    SELECT scan_id, '## Security report' || chr(10) || chr(10) || '**' || total || ' vulnerabilities** found (' || critical || ' critical, ' || warning || ' warning, ' || info || ' info)'
      || CASE WHEN sca > 0 AND total > sca THEN ' - SAST: ' || (total - sca) || ', SCA: ' || sca ELSE '' END || chr(10) || chr(10)
      || coalesce('### Critical' || chr(10) || cl || chr(10) || chr(10), '') || coalesce('### Warning' || chr(10) || wl || chr(10) || chr(10), '')
      || CASE WHEN total > 10 THEN '*...and ' || (total - 10) || ' more*' || chr(10) || chr(10) ELSE '' END || '[View full report](/scans/' || scan_id || ')' AS body FROM g""",
)
def pull_request_report(spark, sf):
    return ex.pull_request_report(d.findings(spark, sf), ["seq"])


@query(
    "scan_notifications",
    f"""WITH {v.scans()}, {v.projects()} SELECT scan_id, user_id, 'scheduled_scan' AS type, 'Scheduled scan: ' || name AS title,
      CASE WHEN critical_count + warning_count + info_count > 0 THEN 'Found ' || (critical_count + warning_count + info_count) || ' vulnerabilities (' || critical_count || ' critical)'
      ELSE 'No vulnerabilities found' END AS message, '/scans/' || scan_id AS link FROM scans JOIN projects USING (project_id) WHERE status = 'completed'""",
)
def scan_notifications(spark, sf):
    return ex.scan_notifications(d.scans(spark, sf), d.projects(spark, sf))


@query(
    "audit_digest",
    f"""{F_}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY severity, seq) AS rn FROM findings WHERE {REAL})
    SELECT scan_id, rn, rn || '. [' || severity || '] ' || rule_name || ' - ' || file_path || ':' || line || chr(10) || '   ' || message || chr(10) || '   Code: ' || snippet AS entry FROM r""",
)
def audit_digest(spark, sf):
    from ..operators.policies import without_markers

    return ex.audit_digest(without_markers(d.findings(spark, sf)))


@query(
    "verdict_merge",
    f"""{F_}, vd AS (SELECT seq, min(line) <> 2 AS is_real, CASE WHEN min(line) = 1 THEN 'info' END AS adj FROM findings WHERE line < 5 GROUP BY 1)
    SELECT f.scan_id, f.seq, coalesce(vd.adj, f.severity) AS severity FROM findings f LEFT JOIN vd USING (seq) WHERE coalesce(vd.is_real, true)""",
)
def verdict_merge(spark, sf):
    f = d.findings(spark, sf)
    verdicts = f.filter(F.col("line") < 5).groupBy("seq").agg(
        (F.min("line") != 2).alias("is_real"), F.when(F.min("line") == 1, "info").alias("adjusted_severity")
    )
    return ex.apply_verdicts(f, verdicts).select("scan_id", "seq", "severity")


@query(
    "sbom_every_scan",
    "SELECT o_orderkey AS scan_id, count(l_orderkey) AS components FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1",
)
def sbom_every_scan(spark, sf):
    """A document for every scan; those without dependencies have no components."""
    deps = mf.dedup_dependencies(d.dependencies(spark, sf), "scan_id", ("source", "line", "dev"))
    return ex.sbom_summary(ex.to_sbom(deps, ["source", "line", "name"], scans=d.scans(spark, sf)))


def _sbom_deps(spark, sf):
    return d.dependencies(spark, sf).withColumn(
        "ecosystem", F.when(F.col("line") == 7, "Maven").otherwise(F.col("ecosystem"))
    ).withColumn("k", F.concat_ws("|", "source", F.format_string("%02d", "line"), "name", F.col("dev").cast("string")))


@query(
    "sbom_components",
    f"""WITH {v.dependencies()}, o AS (SELECT * REPLACE (CASE WHEN line = 7 THEN 'Maven' ELSE ecosystem END AS ecosystem),
      source || '|' || printf('%02d', line) || '|' || name || '|' || CAST(dev AS VARCHAR) AS k FROM deps)
    SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY k) - 1 AS pos, name, version,
      CASE ecosystem WHEN 'npm' THEN 'pkg:npm/' || CASE WHEN starts_with(name, '@') THEN '%40' || substr(name, 2) ELSE name END || '@' || version
        WHEN 'PyPI' THEN 'pkg:pypi/' || lower(name) || '@' || version WHEN 'Go' THEN 'pkg:golang/' || name || '@' || version
        WHEN 'crates.io' THEN 'pkg:cargo/' || name || '@' || version ELSE 'pkg:generic/' || name || '@' || version END AS purl,
      CASE WHEN dev THEN 'excluded' END AS scope, license FROM o""",
)
def sbom_components(spark, sf):
    docs = ex.to_sbom(_sbom_deps(spark, sf), ["k"])
    return ex.read_sbom(docs)


@query(
    "context_excerpt",
    f"""WITH {v.corpus()}, {v.lines()}, w AS (SELECT repo, path, line_no, text,
      string_agg(line_no || ': ' || text, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS excerpt FROM lines)
    SELECT repo, path AS file_path, line_no AS line, excerpt FROM w WHERE language <> 'x' AND regexp_matches(text, '\\beval\\s*\\(\\s*[^"''`\\d)]') AND path NOT LIKE '%.py'""".replace("language <> 'x' AND ", ""),
)
def context_excerpt(spark, sf):
    f = scan(d.corpus(spark, sf), detectors=(23,), declarative=False, secrets=False, excerpt=True)
    return f.filter(~F.col("file_path").endswith(".py")).select("repo", "file_path", "line", "excerpt")


@query("context_excerpt_join", ORACLE["context_excerpt"])
def context_excerpt_join(spark, sf):
    c = d.corpus(spark, sf)
    f = scan(c, detectors=(23,), declarative=False, secrets=False).filter(~F.col("file_path").endswith(".py"))
    return ex.context_excerpt(f, c)


@query(
    "scan_results",
    f"""WITH {v.corpus()}, {v.lines()} SELECT f.repo, f.path AS file_path, f.language, count(l.line_no) AS findings
    FROM files f LEFT JOIN lines l ON l.path = f.path AND regexp_matches(l.text, '^\\s*debugger\\s*;?\\s*$') AND l.language <> 'python' GROUP BY 1, 2, 3""",
)
def scan_results_query(spark, sf):
    c = d.corpus(spark, sf)
    r = scan_results(c, scan(c, detectors=(19,), declarative=False, secrets=False))
    return r.select("repo", "file_path", "language", F.size("findings").cast("bigint").alias("findings"))


# ------------------------------------------------------------------ cache keys
FP = "CASE WHEN coalesce(nm, '') = '' THEN 'no-snippet' ELSE substr(sha256(nm), 1, 16) END"
KEYS = f"""keys AS (SELECT *, 'explain:' || rule_name || ':' || {FP} || ':en' AS explain_key, 'fix:' || rule_name || ':' || {FP} AS fix_key
  FROM (SELECT *, regexp_replace(regexp_replace(snippet, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS nm FROM findings))"""


@query("snippet_fingerprint", f"{F_}, {KEYS} SELECT scan_id, seq, explain_key, fix_key FROM keys")
def snippet_fingerprint(spark, sf):
    f = d.findings(spark, sf)
    return f.select(
        "scan_id", "seq", ex.explain_key(F.col("rule_name"), F.col("snippet"), F.lit("en")).alias("explain_key"),
        ex.fix_key(F.col("rule_name"), F.col("snippet")).alias("fix_key"),
    )


@query("work_units", f"{F_}, {KEYS} SELECT explain_key AS cache_key, count(*) AS findings FROM keys GROUP BY 1")
def work_units(spark, sf):
    return ex.work_units(d.findings(spark, sf))


def _cache(spark, sf):
    """Cached answers: the keys of findings on line 1."""
    f = d.findings(spark, sf).filter(F.col("line") == 1)
    key = ex.explain_key(F.col("rule_name"), F.col("snippet"), F.lit("en")).alias("cache_key")
    return f.groupBy(key).agg(F.max("created_at").alias("created_at"), F.lit("old").alias("response"))


@query(
    "cache_misses",
    f"{F_}, {KEYS} SELECT explain_key AS cache_key, count(*) AS findings FROM keys WHERE explain_key NOT IN (SELECT explain_key FROM keys WHERE line = 1) GROUP BY 1",
)
def cache_misses(spark, sf):
    return ex.cache_misses(work_units(spark, sf), _cache(spark, sf))


@query(
    "cache_upsert",
    f"""{F_}, {KEYS}, c AS (SELECT explain_key AS cache_key, max(created_at) AS t, 'old' AS response FROM keys WHERE line = 1 GROUP BY 1
      UNION ALL SELECT explain_key, max(created_at), 'new' FROM keys WHERE line = 2 GROUP BY 1)
    SELECT cache_key, arg_max(response, (t, response)) AS response FROM c GROUP BY 1""",
)
def cache_upsert(spark, sf):
    key = ex.explain_key(F.col("rule_name"), F.col("snippet"), F.lit("en")).alias("cache_key")
    fresh = d.findings(spark, sf).filter(F.col("line") == 2).groupBy(key).agg(F.max("created_at").alias("created_at"), F.lit("new").alias("response"))
    return ex.cache_upsert(_cache(spark, sf), fresh).select("cache_key", "response")


UPSERT_SQL = ORACLE["cache_upsert"]


@query("cache_upsert_table", UPSERT_SQL)
def cache_upsert_table(spark, sf):
    """The stored table, first loaded with the old entries, then merged with the new ones bucket by bucket."""
    old = _cache(spark, sf).select("cache_key", "response", "created_at")
    key = ex.explain_key(F.col("rule_name"), F.col("snippet"), F.lit("en")).alias("cache_key")
    fresh = d.findings(spark, sf).filter(F.col("line") == 2).groupBy(key).agg(F.max("created_at").alias("created_at"), F.lit("new").alias("response"))
    table = KeyedTable(scratch_path(spark, "cache"), old.schema, ("cache_key",), "created_at", 32).create(spark)
    table.upsert(old)
    table.upsert(fresh)
    return table.read(spark).select("cache_key", "response")


@query(
    "cache_live_entries",
    f"""{F_}, {KEYS}, c AS (SELECT explain_key AS cache_key, max(created_at) AS t FROM keys WHERE line = 1 GROUP BY 1)
    SELECT cache_key FROM c WHERE epoch_ms(TIMESTAMP '2001-10-01 00:00:00') - epoch_ms(t) <= 15724800000""",
)
def cache_live_entries(spark, sf):
    return ex.live_entries(_cache(spark, sf), F.to_timestamp(F.lit("2001-10-01 00:00:00")), 604_800 * 26).select("cache_key")


@query(
    "cache_live_newest",
    f"""{F_}, {KEYS}, c AS (SELECT explain_key AS cache_key, max(created_at) AS t FROM keys WHERE line = 1 GROUP BY 1)
    SELECT cache_key, t AS created_at FROM c WHERE epoch_ms(TIMESTAMP '2001-10-01 00:00:00') - epoch_ms(t) <= 15724800000""",
)
def cache_live_newest(spark, sf):
    as_of = F.to_timestamp(F.lit("2001-10-01 00:00:00"))
    return ex.live_entries(_cache(spark, sf), as_of, 604_800 * 26).select("cache_key", "created_at")
