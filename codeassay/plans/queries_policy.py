"""Registered queries: policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policies as po
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


SCOPE = f"""{v.scans()}, {v.projects()}, {v.policies()}, {v.findings()},
scoped AS (SELECT s.scan_id, p.* EXCLUDE (project_id, user_id) FROM scans s JOIN projects j USING (project_id) JOIN policies p ON p.user_id = j.user_id
  WHERE p.enabled AND (p.project_id IS NULL OR p.project_id = s.project_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) - 1 AS idx FROM findings WHERE rule_id NOT IN ('SCA-META', 'SCA-SKIPPED')),
attr AS (SELECT *, nullif(regexp_extract(rule_name, '^Vulnerable dependency:\\s*(\\S+)', 1), '') AS pkg, contains(rule_name, '(dev)') AS is_dev FROM f),
mt AS (SELECT a.scan_id, s.policy_id, a.idx FROM attr a JOIN scoped s USING (scan_id) WHERE
  (severity_gte IS NULL OR CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END >= CASE severity_gte WHEN 'critical' THEN 2 ELSE 1 END)
  AND (reachable_only IS NULL OR reachable IS TRUE)
  AND (source IS NULL OR (source = 'sast' AND rule_id NOT LIKE 'SCA-%' AND rule_id NOT LIKE 'LICENSE-%') OR (source = 'sca' AND rule_id LIKE 'SCA-%')
       OR (source = 'license' AND rule_id LIKE 'LICENSE-%'))
  AND (cwe_ids IS NULL OR list_contains(cwe_ids, cwe)) AND (NOT has_patterns OR (pkg IS NOT NULL AND (starts_with(pkg, 'p1') OR starts_with(pkg, 'x.+'))))
  AND NOT (no_dev AND is_dev) AND (NOT strong_only OR rule_id = 'LICENSE-COPYLEFT')),
ev AS (SELECT s.scan_id, s.policy_id, s.name AS policy_name, s.action, count(m.idx) AS matched_count, coalesce(list(m.idx ORDER BY m.idx) FILTER (WHERE m.idx IS NOT NULL), []) AS matched_indices
  FROM scoped s LEFT JOIN mt m USING (scan_id, policy_id) GROUP BY ALL),
ev2 AS (SELECT *, CASE WHEN action <> 'ignore' AND matched_count > 0 THEN 'violated' ELSE 'passed' END AS status FROM ev)"""


def _scoped(spark, sf):
    scans = d.scans(spark, sf).join(d.projects(spark, sf).select("project_id", "user_id"), "project_id")
    return po.policies_in_scope(scans, d.policies(spark, sf))


@query("policy_scope", f"WITH {SCOPE} SELECT scan_id, policy_id, action FROM scoped")
def policy_scope(spark, sf):
    return _scoped(spark, sf).select("scan_id", "policy_id", "action")


@query("policy_matches", f"WITH {SCOPE} SELECT scan_id, policy_id, idx FROM mt")
def policy_matches(spark, sf):
    return po.policy_matches(_scoped(spark, sf), d.findings(spark, sf), ["seq"])


@query(
    "policy_match_positions",
    f"WITH {SCOPE} SELECT scan_id, policy_id, idx // 10000 AS part, list(idx ORDER BY idx) AS matched_indices FROM mt GROUP BY 1, 2, 3",
)
def policy_match_positions(spark, sf):
    return po.match_positions(policy_matches(spark, sf))


@query("policy_evaluation", f"WITH {SCOPE} SELECT scan_id, policy_id, policy_name, action, status, matched_count FROM ev2")
def policy_evaluation(spark, sf):
    return po.evaluate_policies(_scoped(spark, sf), d.findings(spark, sf))


@query("policy_evaluation_counts", f"WITH {SCOPE} SELECT policy_id, status, count(*) AS scans, sum(matched_count) AS matched FROM ev2 GROUP BY 1, 2")
def policy_evaluation_counts(spark, sf):
    e = po.evaluate_policies(_scoped(spark, sf), d.findings(spark, sf))
    return e.groupBy("policy_id", "status").agg(F.count("*").alias("scans"), F.sum("matched_count").alias("matched"))


@query(
    "policy_verdict",
    f"""WITH {SCOPE} SELECT s.scan_id, CASE WHEN count(e.policy_id) = 0 THEN NULL WHEN bool_or(e.status = 'violated' AND e.action IN ('block', 'warn')) THEN 'violated' ELSE 'passed' END AS policy_status
    FROM scans s LEFT JOIN ev2 e USING (scan_id) GROUP BY 1""",
)
def policy_verdict(spark, sf):
    return po.scan_verdict(d.scans(spark, sf), po.evaluate_policies(_scoped(spark, sf), d.findings(spark, sf)))


@query(
    "policy_attributes",
    f"WITH {v.findings()} SELECT seq, nullif(regexp_extract(rule_name, '^Vulnerable dependency:\\s*(\\S+)', 1), '') AS package_name, contains(rule_name, '(dev)') AS is_dev FROM findings",
)
def policy_attributes(spark, sf):
    return po.policy_attributes(d.findings(spark, sf)).select("seq", "package_name", "is_dev")


@query(
    "policy_glob",
    """WITH g AS (SELECT p_name AS v, ['small*', '*ring', 's.*', '*', 'red widget', 'r*d*t'][p_partkey % 6 + 1] AS pat FROM part)
    SELECT v AS value, pat AS pattern, v LIKE replace(pat, '*', '%') AS hit, count(*) AS n FROM g GROUP BY ALL""",
)
def policy_glob(spark, sf):
    p = d.table(spark, sf, "part").select(
        F.col("p_name").alias("value"), d._pick(("small*", "*ring", "s.*", "*", "red widget", "r*d*t"), F.col("p_partkey") % 6).alias("pattern")
    )
    return p.groupBy("value", "pattern", po.glob_match(F.col("value"), F.col("pattern")).alias("hit")).agg(F.count("*").alias("n"))


@query(
    "policy_validation",
    """WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name, ['block', 'warn', 'ignore', 'drop', ''][c_custkey % 5 + 1] AS action,
        CASE WHEN c_custkey % 3 = 0 THEN 'd' END AS description, CASE WHEN c_custkey % 4 = 0 THEN '{"source":"sca"}' END AS conditions FROM customer),
    e AS (SELECT *, CASE WHEN coalesce(name, '') = '' OR coalesce(action, '') = '' THEN 'name and action are required'
        WHEN action NOT IN ('block', 'warn', 'ignore') THEN 'action must be block, warn, or ignore' END AS error FROM s)
    SELECT id, error, CASE WHEN error IS NULL THEN coalesce(description, '') ELSE description END AS description,
      CASE WHEN error IS NULL THEN coalesce(conditions, '{}') ELSE conditions END AS conditions FROM e""",
)
def policy_validation(spark, sf):
    k = F.col("c_custkey")
    s = d.table(spark, sf, "customer").select(
        k.alias("id"),
        F.when(k % 7 != 0, F.col("c_name")).alias("name"),
        d._pick(("block", "warn", "ignore", "drop", ""), k % 5).alias("action"),
        F.when(k % 3 == 0, F.lit("d")).alias("description"),
        F.when(k % 4 == 0, F.lit('{"source":"sca"}')).alias("conditions"),
    )
    good, bad = po.validate_policies(s)
    cols = ["id", "error", "description", "conditions"]
    return good.withColumn("error", F.lit(None).cast("string")).select(*cols).unionByName(bad.select(*cols))
