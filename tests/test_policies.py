from pyspark.sql import functions as F

from codeassay.operators import policies as po, reports as rp

COND = po.CONDITIONS


def test_match_and_status(spark):
    findings = spark.createDataFrame(
        [
            (1, "SCA-1", "Vulnerable dependency: lodash (dev)", "critical", "CWE-1395", True, 1),
            (1, "SG-002", "x", "warning", "CWE-89", None, 2),
            (1, "LICENSE-COPYLEFT", "Copyleft license: a", "critical", "", None, 3),
            (1, "SCA-META", "meta", "info", "", None, 4),
        ],
        "scan_id int, rule_id string, rule_name string, severity string, cwe string, reachable boolean, seq int",
    )
    conds = [
        ("p0", "block", "{}"), ("p1", "warn", '{"severity_gte":"critical","source":"sca"}'), ("p2", "ignore", '{"source":"sast"}'),
        ("p3", "block", '{"package_patterns":["lod*"],"include_dev_deps":false}'), ("p4", "block", '{"license_types":["strong-copyleft"]}'),
        ("p5", "warn", '{"reachable_only":true,"cwe_ids":["CWE-1395"]}'), ("p6", "block", '{"package_patterns":["l.d*"]}'),
    ]
    scoped = spark.createDataFrame([(1, i, i, a, c) for i, a, c in conds], "scan_id int, policy_id string, name string, action string, c string")
    scoped = scoped.withColumn("conditions", po.parse_conditions(F.col("c"))).drop("c")
    ev = {r.policy_id: (r.status, r.matched_count) for r in po.evaluate_policies(scoped, findings).collect()}
    assert ev == {
        "p0": ("violated", 3), "p1": ("violated", 1), "p2": ("passed", 1), "p3": ("passed", 0), "p4": ("violated", 1),
        "p5": ("violated", 1), "p6": ("passed", 0),
    }
    pos = {r.policy_id: r.matched_indices for r in po.match_positions(po.policy_matches(scoped, findings, ["seq"])).collect()}
    assert pos["p0"] == [0, 1, 2] and pos["p4"] == [2]


def test_score_and_grade(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 4), (3, 2), (20, 0)], "c int, w int")
    s = rp.security_score(F.col("c"), F.col("w"))
    assert [(r.s, r.g) for r in df.select(s.alias("s"), rp.grade(s).alias("g")).collect()] == [(100, "A"), (90, "A"), (78, "C"), (64, "D"), (0, "F")]


def test_pattern_index_is_the_glob(spark):
    """Every pattern against every package, literal at both ends, one or none."""
    parts = ["", "a", "ab", "@s/", "l.d", "core", "*", "**", "a*b"]
    patterns = [x + y for x in parts for y in parts] + ["*-core", "l*sh", "*o*", None]
    names = ["a", "ab", "aab", "lodash", "x-core", "core", "@s/core", "l.d", "lxd", "aXb", "*"]
    findings = spark.createDataFrame([(i % 2, f"Vulnerable dependency: {n}", i) for i, n in enumerate(names * 2)], "scan_id int, rule_name string, seq int")
    findings = po.policy_attributes(findings)
    conditions = F.struct(F.array("p", F.lit("no such")).alias("package_patterns"))
    scoped = spark.createDataFrame([(s, i, p) for s in (0, 1) for i, p in enumerate(patterns)], "scan_id int, policy_id int, p string").withColumn("conditions", conditions)
    hits = {tuple(r) for r in po.pattern_hits(scoped, findings).collect()}
    slow = findings.select("scan_id", "package_name").distinct().join(scoped, "scan_id").filter(po.glob_match(F.col("package_name"), F.col("p")))
    assert hits == {tuple(r) for r in slow.select("scan_id", "package_name", "policy_id").collect()} and len(hits) > 100
