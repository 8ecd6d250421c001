"""Registered queries: dependency extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from ..operators import manifests as mf
from ..sources import derived_manifests as dm

QUERIES: dict = {}
ORACLE: dict = {}

OUT = ["repo", "source", "name", "version", "ecosystem", "line", "dev", "license", "declared_range"]
_NAMES = (
    "package_json", "package_lock_v2", "package_lock_v1", "yarn_lock_v1", "yarn_lock_berry", "pnpm_lock",
    "requirements_txt", "pipfile", "go_mod", "go_sum", "cargo_toml", "cargo_lock",
)


def _format_query(kind):
    """One format: the files with its name, told apart by their text where two share a name."""

    def run(spark, sf):
        files = dm.manifests(spark, sf).filter(F.col("path").endswith("/" + dm.FORMATS[kind]))
        marker = {1: '"lockfileVersion": 2', 2: '"lockfileVersion": 1', 3: "# yarn lockfile v1", 4: "__metadata:"}.get(kind)
        if marker:
            files = files.filter(F.col("content").contains(marker))
        return mf.parse_manifests(files).select(*OUT)

    return run


for _k, _n in enumerate(_NAMES):
    QUERIES[f"manifest_{_n}"] = _format_query(_k)
    ORACLE[f"manifest_{_n}"] = dm.expected_sql(_k)

QUERIES["manifest_all_formats"] = lambda spark, sf: mf.parse_manifests(dm.manifests(spark, sf)).select(*OUT)
ORACLE["manifest_all_formats"] = dm.expected_sql()


# --------------------------------------------------- advisories and licences
from ..operators import advisories as ad, graph as gr, licenses as lc
from ..sources import derived as d, oracle_views as v
from ..sources.oracle_views import q, sql_list
from ..catalog import registries as reg


def _register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@_register(
    "dependency_dedup",
    f"""WITH {v.dependencies()} SELECT scan_id, ecosystem, name, version, source, line, dev, license FROM (
      SELECT *, row_number() OVER (PARTITION BY scan_id, ecosystem, name, version ORDER BY source, line, dev) AS rn FROM deps) WHERE rn = 1""",
)
def dependency_dedup(spark, sf):
    return mf.dedup_dependencies(d.dependencies(spark, sf), "scan_id", ("source", "line", "dev")).select(
        "scan_id", "ecosystem", "name", "version", "source", "line", "dev", "license"
    )


@_register(
    "dependency_dedup_capped",
    f"""WITH {v.dependencies()}, u AS (SELECT * FROM (SELECT scan_id % 7 AS scan_id, ecosystem, name, version, source, line, dev,
      row_number() OVER (PARTITION BY scan_id % 7, ecosystem, name, version ORDER BY source, line, dev) AS rn FROM deps) WHERE rn = 1)
    SELECT scan_id, count(*) AS packages, greatest(count(*) - {reg.PACKAGE_CAP}, 0) AS over_cap FROM u GROUP BY 1""",
)
def dependency_dedup_capped(spark, sf):
    deps = d.dependencies(spark, sf).withColumn("scan_id", F.col("scan_id") % 7)
    n = F.count("*")
    unique = mf.dedup_dependencies(deps, "scan_id", ("source", "line", "dev")).groupBy("scan_id")
    return unique.agg(n.alias("packages"), F.greatest(n - reg.PACKAGE_CAP, F.lit(0)).alias("over_cap"))


@_register(
    "version_cleaning",
    """WITH r AS (SELECT ['^', '~', '>=', '', '=', 'v'][l_partkey % 6 + 1] || [' ', ''][l_suppkey % 2 + 1] ||
        ['1', '*', 'latest', '1.2', '3.4.5-beta', '10.0 '][l_linenumber % 6 + 1] AS raw FROM lineitem)
    SELECT raw, CASE WHEN regexp_matches(c, '^\\d+\\.\\d+') THEN c END AS version, count(*) AS n
    FROM (SELECT raw, regexp_replace(regexp_replace(raw, '^[\\^~>=<]+', ''), '^\\s+|\\s+$', '', 'g') AS c FROM r) GROUP BY 1, 2""",
)
def version_cleaning(spark, sf):
    l = d.table(spark, sf, "lineitem")
    raw = F.concat(
        d._pick(("^", "~", ">=", "", "=", "v"), F.col("l_partkey") % 6), d._pick((" ", ""), F.col("l_suppkey") % 2),
        d._pick(("1", "*", "latest", "1.2", "3.4.5-beta", "10.0 "), F.col("l_linenumber") % 6),
    )
    return l.select(raw.alias("raw")).groupBy("raw", mf.clean_version(F.col("raw")).alias("version")).agg(F.count("*").alias("n"))


def _advisories(spark, sf):
    return ad.normalise_advisories(ad.parse_advisories(d.advisories_raw(spark, sf)))


@_register("advisory_normalise", f"WITH {v.advisories()} SELECT id, summary, severity, cvss_score, fixed_version, cve, name, ecosystem, [version, '99.0.0'] AS versions, url FROM adv")
def advisory_normalise(spark, sf):
    a = _advisories(spark, sf)
    return a.select(
        "id", "summary", "severity", "cvss_score", "fixed_version",
        F.coalesce(F.get(F.filter("aliases", lambda x: x.startswith("CVE-")), F.lit(0)), F.col("id")).alias("cve"),
        F.col("packages")[0]["name"].alias("name"), F.col("packages")[0]["ecosystem"].alias("ecosystem"),
        F.col("packages")[0]["versions"].alias("versions"), F.col("references")[0].alias("url"),
    )


_LABEL = "CASE WHEN dev THEN ' (dev)' ELSE '' END"
SCA_SQL = f"""sca AS (
  SELECT d.scan_id, 'SCA-' || a.id AS rule_id, 'Vulnerable dependency: ' || d.name || {_LABEL} AS rule_name, a.severity,
    d.name || '@' || d.version || {_LABEL} || ' has a known vulnerability: ' || a.summary || ' (' || a.cve || ')' AS message,
    d.source AS file_path, d.line, '[' || d.ecosystem || '] "' || d.name || '": "' || d.version || '"' AS snippet,
    'Upgrade ' || d.name || ' to a non-vulnerable version.' || CASE WHEN a.fixed_version IS NOT NULL THEN ' Safe version: ' || a.fixed_version || '. ' ||
      CASE d.ecosystem WHEN 'npm' THEN 'Run: npm install ' || d.name || '@' || a.fixed_version || CASE WHEN dev THEN ' --save-dev' ELSE '' END
        WHEN 'PyPI' THEN 'Run: pip install ' || d.name || '==' || a.fixed_version WHEN 'Go' THEN 'Run: go get ' || d.name || '@' || a.fixed_version
        ELSE 'Update Cargo.toml: ' || d.name || ' = "' || a.fixed_version || '"' END
      ELSE ' Check the advisory for remediation steps.' END AS suggestion,
    d.ecosystem || ':' || d.name || '@' || d.version AS dep_key
  FROM deps d JOIN (SELECT * FROM adv UNION ALL SELECT * REPLACE ('99.0.0' AS version) FROM adv) a USING (ecosystem, name, version))"""
_SCA_COLS = ["scan_id", "rule_id", "rule_name", "severity", "message", "file_path", "line", "snippet", "suggestion"]


@_register("advisory_join", f"WITH {v.dependencies()}, {v.advisories()}, {SCA_SQL} SELECT {', '.join(_SCA_COLS)} FROM sca")
def advisory_join(spark, sf):
    return ad.scan_sca(d.dependencies(spark, sf), _advisories(spark, sf), "scan_id").select(*_SCA_COLS)


RANGE_SQL = """WITH dep AS (SELECT DISTINCT l_partkey AS k, (l_suppkey % 10) || '.' || l_linenumber || '.' || (l_orderkey % 12) || CASE WHEN l_orderkey % 5 = 0 THEN '-beta.' || (l_orderkey % 13) ELSE '' END AS version,
    [l_suppkey % 10, l_linenumber, l_orderkey % 12, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 13 ELSE 0 END] AS v FROM lineitem),
  adv AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN [0, 0, 0, 0, 0] ELSE [p_size % 10, p_partkey % 4, 0, 1, 0] END AS low,
    CASE WHEN p_partkey % 4 <> 1 THEN [p_size % 10 + 2, p_partkey % 7, p_partkey % 11, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END] END AS fix FROM part)
  SELECT dep.k AS part, 'R-' || dep.k AS id, version FROM dep JOIN adv ON dep.k = adv.k AND (adv.k % 3 = 0 OR v >= low) AND (fix IS NULL OR v < fix)"""


def _ranged_advisories(spark, sf):
    """part -> advisories that only name ranges, as JSON text."""
    k, size, text = F.col("p_partkey"), F.col("p_size"), lambda c: c.cast("string")
    low = F.when(k % 3 == 0, "0").otherwise(F.concat_ws(".", text(size % 10), text(k % 4), F.lit("0")))
    fix = F.concat(F.concat_ws(".", text(size % 10 + 2), text(k % 7), text(k % 11)), F.when(k % 5 == 0, "-beta.3").otherwise(""))
    events = F.when(k % 4 != 1, F.concat(F.lit('{"introduced":"'), low, F.lit('"},{"fixed":"'), fix, F.lit('"}'))).otherwise(F.concat(F.lit('{"introduced":"'), low, F.lit('"}')))
    doc = F.concat(
        F.lit('{"id":"R-'), text(k), F.lit('","affected":[{"package":{"name":"p'), text(k), F.lit('","ecosystem":"npm"},"ranges":[{"events":['), events, F.lit("]}]}]}")
    )
    return ad.normalise_advisories(ad.parse_advisories(d.table(spark, sf, "part").select(doc.alias("value"))))


@_register("advisory_range_join", RANGE_SQL)
def advisory_range_join(spark, sf):
    """Package versions inside the ranges of advisories without version lists."""
    o, text = F.col("l_orderkey"), lambda c: c.cast("string")
    version = F.concat(F.concat_ws(".", text(F.col("l_suppkey") % 10), text(F.col("l_linenumber")), text(o % 12)), F.when(o % 5 == 0, F.concat(F.lit("-beta."), text(o % 13))).otherwise(""))
    used = d.table(spark, sf, "lineitem").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), text(F.col("l_partkey"))).alias("name"), version.alias("version")).distinct()
    hits = ad.range_hits(used, _ranged_advisories(spark, sf))
    return hits.select(F.substr("name", F.lit(2)).cast("bigint").alias("part"), "adv.id", "version")


@_register(
    "clean_dependencies",
    f"""WITH {v.dependencies()}, {v.advisories()} SELECT ecosystem, count(*) AS n FROM deps d WHERE NOT EXISTS (
      SELECT 1 FROM adv a WHERE a.ecosystem = d.ecosystem AND a.name = d.name AND a.version = d.version) GROUP BY 1""",
)
def clean_dependencies(spark, sf):
    affected = ad.affected_versions(_advisories(spark, sf)).select("ecosystem", "name", "version").distinct()
    return (
        d.dependencies(spark, sf).join(affected, ["ecosystem", "name", "version"], "left_anti").groupBy("ecosystem").agg(F.count("*").alias("n"))
    )


@_register(
    "sca_metrics",
    f"WITH {v.dependencies()} SELECT scan_id, count(DISTINCT ecosystem || name || version) AS dep_count, false AS skipped FROM deps GROUP BY 1",
)
def sca_metrics(spark, sf):
    unique = mf.dedup_dependencies(d.dependencies(spark, sf), "scan_id", ("source", "line", "dev"))
    return ad.sca_metrics(unique, _advisories(spark, sf), "scan_id")


@_register(
    "sca_failed_lookups",
    f"""WITH {v.dependencies()}, {v.advisories()}, {SCA_SQL}, failed AS (SELECT o_orderkey AS scan_id FROM orders WHERE o_orderstatus = 'P'),
    n AS (SELECT scan_id, count(*) AS findings FROM sca WHERE scan_id NOT IN (SELECT scan_id FROM failed) GROUP BY 1)
    SELECT d.scan_id, count(DISTINCT ecosystem || name || version) AS dep_count, d.scan_id IN (SELECT scan_id FROM failed) AS skipped, coalesce(any_value(findings), 0) AS findings
    FROM deps d LEFT JOIN n ON n.scan_id = d.scan_id GROUP BY d.scan_id""",
)
def sca_failed_lookups(spark, sf):
    """Scans whose advisory look-up broke off keep their packages, have no findings and are marked as skipped."""
    deps, advisories = d.dependencies(spark, sf), _advisories(spark, sf)
    failed = d.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("scan_id"))
    metrics = ad.sca_metrics(mf.dedup_dependencies(deps, "scan_id", ("source", "line", "dev")), advisories, "scan_id", failed)
    n = ad.scan_sca(deps, advisories, "scan_id", failed).groupBy("scan_id").agg(F.count("*").alias("findings"))
    return metrics.join(n, "scan_id", "left").select("scan_id", "dep_count", "skipped", F.coalesce("findings", F.lit(0)).alias("findings"))


@_register(
    "sca_without_advisories",
    f"WITH {v.dependencies()} SELECT scan_id, count(DISTINCT ecosystem || name || version) AS dep_count, true AS skipped FROM deps GROUP BY 1",
)
def sca_without_advisories(spark, sf):
    """An empty snapshot has nothing to check against."""
    unique = mf.dedup_dependencies(d.dependencies(spark, sf), "scan_id", ("source", "line", "dev"))
    return ad.sca_metrics(unique, _advisories(spark, sf).filter("id is null"), "scan_id")


#: Packages of many versions and many intervals: a hundred parts make one.
INDEX_SQL = """WITH dep AS (SELECT DISTINCT l_partkey // 100 AS g, (l_suppkey % 10) || '.' || (l_orderkey % 97) || '.' || l_linenumber AS version, [l_suppkey % 10, l_orderkey % 97, l_linenumber] AS v FROM lineitem),
  adv AS (SELECT p_partkey AS k, p_partkey // 100 AS g, [p_partkey % 10, p_size, 0] AS low, CASE WHEN p_partkey % 9 <> 4 THEN [p_partkey % 10, p_size + p_partkey % 13, 3] END AS fix FROM part)
  SELECT 'I-' || k AS id, count(*) AS versions FROM dep JOIN adv USING (g) WHERE v >= low AND (fix IS NULL OR v < fix) GROUP BY 1"""


@_register("advisory_interval_index", INDEX_SQL)
def advisory_interval_index(spark, sf):
    """How many used versions each advisory hits, for packages with thousands of versions and a hundred intervals."""
    text, k, size, o = (lambda c: c.cast("string")), F.col("p_partkey"), F.col("p_size"), F.col("l_orderkey")
    name = lambda c: F.concat(F.lit("g"), text(F.floor(c / 100)))
    version = F.concat_ws(".", text(F.col("l_suppkey") % 10), text(o % 97), text(F.col("l_linenumber")))
    used = d.table(spark, sf, "lineitem").select(F.lit("npm").alias("ecosystem"), name(F.col("l_partkey")).alias("name"), version.alias("version"))
    used = used.repartition("name", "version").distinct()  # tables of distinct rows before the shuffle would outgrow their tasks
    low = F.concat_ws(".", text(k % 10), text(size), F.lit("0"))
    fix = F.when(k % 9 != 4, F.concat(F.lit('},{"fixed":"'), F.concat_ws(".", text(k % 10), text(size + k % 13), F.lit("3")), F.lit('"'))).otherwise("")
    doc = F.concat(
        F.lit('{"id":"I-'), text(k), F.lit('","affected":[{"package":{"name":"'), name(k), F.lit('","ecosystem":"npm"},"ranges":[{"events":[{"introduced":"'), low, F.lit('"'), fix, F.lit("}]}]}]}")
    )
    advisories = ad.normalise_advisories(ad.parse_advisories(d.spread(d.table(spark, sf, "part").select("p_partkey", "p_size")).select(doc.alias("value"))))
    return ad.range_hits(used, advisories).groupBy("adv.id").agg(F.count("*").alias("versions"))


_PARTS = f"""parts AS (
  SELECT *, CASE WHEN len(list_intersect(list_transform(regexp_split_to_array(license, '(?i)\\s+OR\\s+|\\s+AND\\s+|\\s*\\(\\s*|\\s*\\)\\s*'), lambda x: trim(x)), {sql_list(reg.STRONG_COPYLEFT)})) > 0 THEN 'critical'
    WHEN len(list_intersect(list_transform(regexp_split_to_array(license, '(?i)\\s+OR\\s+|\\s+AND\\s+|\\s*\\(\\s*|\\s*\\)\\s*'), lambda x: trim(x)), {sql_list(reg.WEAK_COPYLEFT)})) > 0 THEN 'warning' ELSE 'none' END AS risk
  FROM deps WHERE license IS NOT NULL)"""


@_register("license_classification", f"WITH {v.dependencies()}, {_PARTS} SELECT license, risk, count(*) AS n FROM parts GROUP BY 1, 2")
def license_classification(spark, sf):
    deps = d.dependencies(spark, sf).filter(F.col("license").isNotNull())
    return deps.groupBy("license", lc.license_risk(F.col("license")).alias("risk")).agg(F.count("*").alias("n"))


@_register(
    "license_findings",
    f"""WITH {v.dependencies()}, {_PARTS} SELECT scan_id, CASE risk WHEN 'critical' THEN 'LICENSE-COPYLEFT' ELSE 'LICENSE-WEAK-COPYLEFT' END AS rule_id,
      'Copyleft license: ' || name || {_LABEL} AS rule_name, risk AS severity, source AS file_path, line,
      '[' || ecosystem || '] "' || name || '": "' || version || '" \u2014 License: ' || license AS snippet
    FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, ecosystem, name, version ORDER BY source, line, dev) AS rn FROM parts)
    WHERE rn = 1 AND risk <> 'none'""",
)
def license_findings(spark, sf):
    unique = mf.dedup_dependencies(d.dependencies(spark, sf), "scan_id", ("source", "line", "dev"))
    return lc.license_findings(unique, "scan_id").select("scan_id", "rule_id", "rule_name", "severity", "file_path", "line", "snippet")


@_register("license_distribution", f"WITH {v.dependencies()} SELECT license, count(*) AS n FROM deps WHERE license IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def license_distribution(spark, sf):
    return lc.license_distribution(d.dependencies(spark, sf))


# -------------------------------------------------------------------- graph
@_register(
    "dependency_edges",
    f"""WITH {dm.items_sql()}, dep AS (SELECT k, i, n, v FROM it WHERE kind = 1 AND m <> 2),
    req AS (SELECT b.k, b.i, b.n || '@' || b.v AS parent, c.n AS child, '~2.0.0' AS range FROM dep b JOIN it c ON c.k = b.k AND c.i = b.i - 1),
    v1 AS (SELECT k, i, n || '@' || v AS parent, 'c' || i AS child, '^9.0.0' AS range FROM it WHERE kind = 2 AND m = 0)
    SELECT 'r' || r.k AS repo, 'npm:' || parent AS parent_key, 'npm:' || child || '@' || d.v AS child_key, range FROM req r JOIN dep d ON d.k = r.k AND d.n = r.child
    UNION ALL SELECT 'r' || k, 'npm:' || parent, 'npm:' || child || '@9.9.9', range FROM v1""",
)
def dependency_edges(spark, sf):
    entries = cut_lineage(mf.lock_entries(mf.package_locks(dm.manifests(spark, sf))))
    deps = entries.select("repo", F.col("path").alias("source"), "ord", "name", "version", F.lit("npm").alias("ecosystem"))
    return gr.resolve_edges(gr.lock_requirements(entries), deps).select("repo", "parent_key", "child_key", "range")


@_register(
    "dependency_ranges",
    f"""WITH {v.dependencies()}, {v.edges()},
    own AS (SELECT DISTINCT scan_id // {d.SCAN_ORDERS} + 1 AS scan_id, ecosystem || ':' || name || '@' || version AS dep_key, declared_range AS range, 0 AS p, '' AS parent FROM deps WHERE declared_range IS NOT NULL),
    asked AS (SELECT scan_id, child_key, '^' || length(parent_key) AS range, 1, parent_key FROM edges),
    a AS (SELECT * FROM own UNION ALL SELECT * FROM asked)
    SELECT scan_id, dep_key, range FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, dep_key ORDER BY p, parent, range) AS rn FROM a) WHERE rn = 1""",
)
def dependency_ranges(spark, sf):
    deps = d.dependencies(spark, sf).withColumn("scan_id", F.expr(f"scan_id div {d.SCAN_ORDERS} + 1"))
    edges = d.edges(spark, sf).select(
        "*", F.concat(F.lit("^"), F.length("parent_key").cast("string")).alias("range"), F.lit("lock").alias("path"),
        F.array(F.lit(0)).alias("ord"),
    )
    return gr.dep_ranges(deps, edges, "scan_id")


@_register(
    "import_extraction",
    f"""WITH {v.corpus()}, j AS (
      SELECT repo, unnest(regexp_extract_all(content, {q(gr.JS_IMPORT)}, 1) || regexp_extract_all(content, {q(gr.JS_REQUIRE)}, 1)) AS s
      FROM corpus WHERE list_contains({sql_list(reg.IMPORT_EXTENSIONS_JS)}, lower(regexp_extract(path, '\\.([^./]+)$', 1)))),
    p AS (SELECT repo, unnest(list_zip(regexp_extract_all(content, {q(gr.PY_IMPORT)}, 1), regexp_extract_all(content, {q(gr.PY_IMPORT)}, 2))) AS z
      FROM corpus WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) = 'py')
    SELECT DISTINCT repo, CASE WHEN starts_with(s, '@') THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END AS package
    FROM j WHERE NOT starts_with(s, '.') AND NOT starts_with(s, '/')
    UNION SELECT DISTINCT repo, string_split(CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END, '.')[1] FROM p""",
)
def import_extraction(spark, sf):
    return gr.imports(d.corpus(spark, sf))


def _marked_sql(name: str, times: int, plus: int) -> str:
    return f"""{name} AS (SELECT 0 AS scan_id, 'npm:p' || (s_suppkey * {times} + {plus}) || '@1.0.0' AS dep_key FROM supplier
      UNION ALL SELECT s_suppkey + 1, 'npm:p' || (s_suppkey * {d.SCAN_ORDERS} + {times} + {plus}) || '@1.0.0' FROM supplier)"""


def _marked(spark, sf, times: int, plus: int):
    """A package of the large scan and one of a small scan for each supplier."""
    k = F.col("s_suppkey")
    two = F.array(
        F.struct(F.lit(0).cast("bigint").alias("scan_id"), d.package_key(k * times + plus).alias("dep_key")),
        F.struct((k + 1).cast("bigint").alias("scan_id"), d.package_key(k * d.SCAN_ORDERS + times + plus).alias("dep_key")),
    )
    return d.table(spark, sf, "supplier").select(F.inline(two))


SEEDS, TARGETS = (7, 1), (29, 401)
SEEDS_SQL, TARGETS_SQL = _marked_sql("seeds", *SEEDS), _marked_sql("targets", *TARGETS)


@_register(
    "reachability",
    f"""WITH RECURSIVE {v.edges()}, {SEEDS_SQL}, r(scan_id, dep_key) AS (
      SELECT scan_id, dep_key FROM seeds UNION SELECT e.scan_id, e.child_key FROM r JOIN edges e ON e.scan_id = r.scan_id AND e.parent_key = r.dep_key)
    SELECT scan_id, dep_key FROM r""",
)
def reachability(spark, sf):
    return gr.reachability(d.edges(spark, sf), _marked(spark, sf, *SEEDS), "scan_id").select("scan_id", "dep_key")


@_register(
    "reachable_flag",
    f"""WITH {v.findings()}, reach AS (SELECT DISTINCT scan_id, 'npm:p' || (scan_id % 50) || '@' || (scan_id % 4) || '.0.1' AS dep_key FROM findings)
    SELECT f.scan_id, f.seq, f.rule_id, CASE WHEN f.rule_id LIKE 'SCA-%' AND regexp_matches(snippet, '^\\[(\\w+)\\]\\s*"([^"]+)":\\s*"([^"]+)"$')
      THEN EXISTS (SELECT 1 FROM reach r WHERE r.scan_id = f.scan_id AND r.dep_key = regexp_replace(snippet, '^\\[(\\w+)\\]\\s*"([^"]+)":\\s*"([^"]+)"$', '\\1:\\2@\\3')) END AS reachable
    FROM findings f""",
)
def reachable_flag(spark, sf):
    f = d.findings(spark, sf).drop("reachable")
    reach = f.select(
        "scan_id",
        F.concat(F.lit("npm:p"), (F.col("scan_id") % 50).cast("string"), F.lit("@"), (F.col("scan_id") % 4).cast("string"), F.lit(".0.1")).alias("dep_key"),
    ).distinct()
    return gr.flag_reachable(f, reach, "scan_id").select("scan_id", "seq", "rule_id", "reachable")


def _chain_sql():
    lv = ["l1 AS (SELECT DISTINCT scan_id, dep_key AS target, dep_key AS node, [dep_key] AS chain FROM targets)"]
    for n in range(2, 6):
        seen = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM l{j} s WHERE s.scan_id = x.scan_id AND s.target = x.target AND s.node = x.node)" for j in range(2, n)
        )
        lv.append(
            f"""l{n} AS (SELECT scan_id, target, node, min(chain) AS chain FROM (
              SELECT l.scan_id, l.target, u.parent AS node, list_append(l.chain, u.parent) AS chain FROM l{n - 1} l JOIN up u ON u.scan_id = l.scan_id AND u.node = l.node) x
              WHERE true{seen} GROUP BY 1, 2, 3)"""
        )
    done = " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(1, 6))
    return f"""WITH {v.edges()}, {TARGETS_SQL}, up AS (SELECT DISTINCT scan_id, child_key AS node, parent_key AS parent FROM edges), {', '.join(lv)},
    done AS (SELECT * FROM ({done}) a WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.scan_id = a.scan_id AND up.node = a.node))
    SELECT scan_id, target, array_to_string(chain, ' < ') AS chain, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY scan_id, target ORDER BY len(chain), chain) AS rank FROM done) WHERE rank <= 3"""


@_register("dependency_chains", _chain_sql())
def dependency_chains(spark, sf):
    c = gr.dep_chains(d.edges(spark, sf), _marked(spark, sf, *TARGETS), "scan_id", max_depth=5, max_paths=3)
    return c.select("scan_id", "target", F.array_join("chain", " < ").alias("chain"), "rank")
