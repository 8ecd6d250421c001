"""Registered queries: corpus selection, lines, context, taint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import detectors as cat, registries as reg
from ..functions.regex import alternation
from ..functions.session import scratch_path
from ..functions.text import lines_of
from ..operators import corpus as co, files as fi, lines as li
from ..sources import derived as d, oracle_views as v, tables, tree
from ..sources.oracle_views import m, q, sql_list
from .sast_oracle import context_lines

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


CORPUS = f"WITH {v.corpus()}"
FILES = f"{CORPUS}, {v.lines()}"


@query("language_detection", f"{FILES} SELECT language, count(*) AS files, sum(length(content)) AS chars FROM files GROUP BY 1")
def language_detection(spark, sf):
    return co.detect_language(d.corpus(spark, sf)).groupBy("language").agg(
        F.count("*").alias("files"), F.sum("size").alias("chars")
    )


@query(
    "catalog_tables",
    """SELECT p.project_id, p.name, count(s.o_orderkey) AS scans, count(s.o_orderkey) FILTER (WHERE s.o_orderstatus = 'F') AS completed, max(CAST(s.o_orderdate AS TIMESTAMP)) AS last_scan, CAST(NULL AS VARCHAR) AS github_url
    FROM (SELECT c_custkey AS project_id, 'org' || c_nationkey || '/' || lower(c_mktsegment) || '-' || (c_custkey % 100) AS name FROM customer) p LEFT JOIN orders s ON s.o_custkey = p.project_id GROUP BY 1, 2""",
)
def catalog_tables(spark, sf):
    """Projects and scans written as catalog tables, each in another format, and read back by their declared schemas."""
    folder = scratch_path(spark, "catalog")
    tables.write_table(d.projects(spark, sf), folder, "projects", "json")
    tables.write_table(d.scans(spark, sf), folder, "scans")
    projects, scans = tables.read_table(spark, folder, "projects", "json"), tables.read_table(spark, folder, "scans")
    done = scans.groupBy("project_id").agg(F.count("*").alias("scans"), F.count_if(F.col("status") == "completed").alias("completed"), F.max("created_at").alias("last_scan"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return projects.join(done, "project_id", "left").select("project_id", "name", zero("scans"), zero("completed"), "last_scan", "github_url")


FILE_NAMES = ("app/[locale]/page.tsx", "a b/{id}/x.js", "q?*/[...all].mjs", "pc%20t/%5B.py", "__init__.py", ".config/_x.JS", "node_modules/y/z.js", "notes [1].md", "package.json", "é/ü.ts")


@query(
    "corpus_from_files",
    f"""SELECT 'f' || (doc_id % 7) AS repo, 'f' || (doc_id % 7) || '/' || doc_id || '/' || {sql_list(FILE_NAMES)}[doc_id % {len(FILE_NAMES)} + 1] AS path, md5(text) AS digest, strlen(text) AS size
    FROM documents WHERE doc_id % {len(FILE_NAMES)} NOT IN (6, 7)""",
)
def corpus_from_files(spark, sf):
    """documents written as files under names full of special characters, and read as a corpus."""
    root, k = scratch_path(spark, "tree [x] {y}"), F.col("doc_id")
    names = F.element_at(F.array(*[F.lit(x) for x in FILE_NAMES]), (k % len(FILE_NAMES) + 1).cast("int"))
    path = F.concat(F.lit("f"), (k % 7).cast("string"), F.lit("/"), k.cast("string"), F.lit("/"), names)
    tree.write_tree(d.spread(d.table(spark, sf, "documents")).select(path.alias("path"), F.col("text").alias("content")), root)
    return co.read_corpus(spark, root).select("repo", "path", F.md5("content").alias("digest"), "size")


@query(
    "language_guess",
    f"""{CORPUS}, g AS (SELECT path, content, regexp_replace(content, '^\\s+', '') AS t FROM corpus)
    SELECT path, CASE WHEN (starts_with(t, 'import ') AND NOT {m('t', "^import [{'\"]")}) OR starts_with(t, 'from ')
      OR {m('t', r'\bdef\s+\w+\s*\(')} OR {m('t', r'\bclass\s+\w+.*:')} OR contains(t, 'print(') THEN 'python'
      WHEN {m('content', r':\s*(?:string|number|boolean|void)\b')} OR {m('content', r'interface\s+\w+')} THEN 'typescript'
      ELSE 'javascript' END AS language FROM g""",
)
def language_guess(spark, sf):
    return d.corpus(spark, sf).select("path", co.guess_language(F.col("content")).alias("language"))


FOLDERS = ("src", "node_modules", "lib/dist", "a/vendor", "build", "app\\venv", "coverage-x", "docs")
SUFFIXES = ("/f.js", "/f.min.js", "/build", "/x.PY", "/g.ts")
IGNORE_FILE = "# local rules\n\n*.min.js\nvendor/\ndocs\n"


def _path_expr():
    k = F.col("doc_id")
    return F.concat(
        F.lit("/r/"), d._pick(FOLDERS, k % len(FOLDERS)), F.lit("/"), k.cast("string"), d._pick(SUFFIXES, F.floor(k / 8) % len(SUFFIXES))
    )


PATHS_SQL = f"""paths AS (SELECT doc_id, '/r/' || {sql_list(FOLDERS)}[doc_id % {len(FOLDERS)} + 1] || '/' || doc_id ||
  {sql_list(SUFFIXES)}[(doc_id // 8) % {len(SUFFIXES)} + 1] AS path FROM documents)"""


@query(
    "ignore_filter",
    f"""WITH {PATHS_SQL}, pat(p) AS (VALUES {', '.join('(' + q(p) + ')' for p in co.ignore_patterns(IGNORE_FILE))})
    SELECT path FROM paths WHERE NOT EXISTS (SELECT 1 FROM pat WHERE contains(replace(path, '\\', '/'), '/' || p || '/')
      OR ends_with(replace(path, '\\', '/'), '/' || p) OR (starts_with(p, '*.') AND ends_with(replace(path, '\\', '/'), substr(p, 2))))""",
)
def ignore_filter(spark, sf):
    paths = d.table(spark, sf, "documents").select(_path_expr().alias("path"))
    return paths.filter(~co.is_ignored(F.col("path"), co.ignore_patterns(IGNORE_FILE)))


TREE_NAMES = ("a.js", "b.TSX", "package.json", "c.mts", "yarn.lock", "d.py", "e.md", "dist/f.js", "vendor/g.py")
TREE_SQL = f"""tree AS (SELECT 'r' || (l_suppkey % 20) AS repo,
   'src/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || {sql_list(TREE_NAMES)}[l_partkey % {len(TREE_NAMES)} + 1] AS path,
   CASE WHEN l_quantity = 7 THEN 'tree' ELSE 'blob' END AS type, CAST(floor(l_extendedprice) AS BIGINT) * 10 AS size FROM lineitem)"""


def _tree(spark, sf):
    l = d.table(spark, sf, "lineitem")
    return l.select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 20).cast("string")).alias("repo"),
        F.concat(
            F.lit("src/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("/"),
            F.col("l_partkey").cast("string"), F.lit("/"), d._pick(TREE_NAMES, F.col("l_partkey") % len(TREE_NAMES)),
        ).alias("path"),
        F.when(F.col("l_quantity") == 7, "tree").otherwise("blob").alias("type"),
        (F.floor("l_extendedprice") * 10).cast("bigint").alias("size"),
    )


def _tree_where(cap):
    names, exts, skip = sql_list(reg.MANIFEST_NAMES), sql_list(reg.HOSTED_EXTENSIONS), sql_list(reg.TREE_SKIP_SEGMENTS)
    return f"""type = 'blob' AND NOT list_has_any(string_split(path, '/'), {skip}) AND (list_contains({names}, string_split(path, '/')[-1])
      OR ({'true' if cap is None else f'size <= {cap}'} AND list_contains({exts}, lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)))))"""


@query(
    "tree_filter_capped",
    f"""WITH {TREE_SQL}, kept AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM (SELECT DISTINCT * FROM tree) WHERE {_tree_where(None)})
    SELECT repo, count(*) AS files, count(*) FILTER (WHERE rn > {reg.TREE_FILE_CAP}) AS over_cap, count(*) FILTER (WHERE size > {reg.TREE_SIZE_CAP}) AS large FROM kept GROUP BY repo""",
)
def tree_filter_capped(spark, sf):
    """All files of each repository, and how many a hosted service would leave out by number or size."""
    kept = co.tree_filter(_tree(spark, sf).distinct())
    n = F.count("*")
    over, large = F.greatest(n - reg.TREE_FILE_CAP, F.lit(0)), F.count_if(F.col("size") > reg.TREE_SIZE_CAP)
    return kept.groupBy("repo").agg(n.alias("files"), over.alias("over_cap"), large.alias("large"))


@query(
    "tree_filter_public",
    f"""WITH {TREE_SQL} SELECT repo, count(*) AS files, sum(size) AS bytes, count(*) FILTER (WHERE size > {reg.TREE_SIZE_CAP_PUBLIC}) AS large
    FROM tree WHERE {_tree_where(None)} GROUP BY 1""",
)
def tree_filter_public(spark, sf):
    kept = co.tree_filter(_tree(spark, sf)).groupBy("repo")
    return kept.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("size") > reg.TREE_SIZE_CAP_PUBLIC).alias("large"))


@query(
    "manifest_detection",
    f"WITH {TREE_SQL} SELECT string_split(path, '/')[-1] AS name, count(*) AS n FROM tree WHERE list_contains({sql_list(reg.MANIFEST_NAMES)}, string_split(path, '/')[-1]) GROUP BY 1",
)
def manifest_detection(spark, sf):
    return (
        _tree(spark, sf).filter(co.is_manifest(F.col("path")))
        .groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("n"))
    )


@query(
    "changed_files_pull_request",
    f"""WITH {TREE_SQL}, pr AS (SELECT DISTINCT repo, path, CASE WHEN size % 3 = 0 THEN 'removed' ELSE 'modified' END AS status FROM tree)
    SELECT repo, path, status FROM pr WHERE status <> 'removed' AND (list_contains({sql_list(reg.MANIFEST_NAMES)}, string_split(path, '/')[-1])
      OR list_contains({sql_list(reg.HOSTED_EXTENSIONS)}, lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1))))""",
)
def changed_files_pull_request(spark, sf):
    pr = _tree(spark, sf).select(
        "repo", "path", F.when(F.col("size") % 3 == 0, "removed").otherwise("modified").alias("status")
    ).distinct()
    return co.changed_in_pull_request(pr)


@query(
    "changed_files_scope",
    f"""{CORPUS}, twice AS (SELECT doc_id, repo, path, content FROM corpus UNION ALL SELECT doc_id + 1, 'fork', path, content FROM corpus),
    names AS (
      SELECT repo, trim(p) AS path FROM (
        SELECT repo, CASE WHEN doc_id % 2 = 0 THEN path || ' ' ELSE '' END AS p FROM twice UNION ALL
        SELECT repo, CASE WHEN doc_id % 3 = 0 THEN path ELSE ' ' END FROM twice UNION ALL
        SELECT repo, CASE WHEN doc_id % 7 = 0 THEN path ELSE '' END FROM twice) WHERE trim(p) <> '')
    SELECT repo, path, length(content) AS size FROM twice WHERE (repo, path) IN (SELECT repo, path FROM names)""",
)
def changed_files_scope(spark, sf):
    c = d.corpus(spark, sf).select("doc_id", "repo", "path", "size")
    c = c.union(c.select(F.col("doc_id") + 1, F.lit("fork"), "path", "size"))  # the same paths in another repository
    part = lambda n, hit, miss: c.select("repo", F.when(F.col("doc_id") % n == 0, hit).otherwise(F.lit(miss)).alias("path"))
    changed = co.changed_in_work_tree(
        part(2, F.concat("path", F.lit(" ")), ""), part(3, F.col("path"), " "), part(7, F.col("path"), "")
    )
    return co.restrict_to(c, changed).select("repo", "path", "size")


URL_TAILS = (".git", "#readme", "/tree/main", "?tab=1", "", " x")


@query(
    "repository_url_parse",
    f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN url ELSE 'https://github.com/o' || (page_id % 13) || '/r' || page_id ||
      {sql_list(URL_TAILS)}[page_id % {len(URL_TAILS)} + 1] END AS url FROM pages)
    SELECT page_id, CASE WHEN hit THEN regexp_extract(url, 'github\\.com/([^/]+)/([^/\\s#?]+)', 1) END AS owner,
      CASE WHEN hit THEN regexp_replace(regexp_extract(url, 'github\\.com/([^/]+)/([^/\\s#?]+)', 2), '\\.git$', '') END AS repo
    FROM (SELECT *, regexp_matches(url, 'github\\.com/([^/]+)/([^/\\s#?]+)') AS hit FROM u)""",
)
def repository_url_parse(spark, sf):
    k = F.col("page_id")
    p = d.table(spark, sf, "pages").select(
        "page_id",
        F.when(k % 9 == 0, F.col("url"))
        .otherwise(F.concat(F.lit("https://github.com/o"), (k % 13).cast("string"), F.lit("/r"), k.cast("string"), d._pick(URL_TAILS, k % len(URL_TAILS))))
        .alias("url"),
    )
    r = co.repo_of_url(F.col("url"))
    return p.select("page_id", r["owner"].alias("owner"), r["repo"].alias("repo"))


@query("line_explode", f"{FILES} SELECT repo, path, line_no, text FROM lines")
def line_explode(spark, sf):
    return li.explode_lines(co.detect_language(d.corpus(spark, sf)))


@query(
    "line_context_window",
    f"""{FILES}, w AS (SELECT repo, path, line_no, text,
      string_agg(text, '|') OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS context FROM lines)
    SELECT repo, path, line_no, md5(context) AS context_digest, length(context) AS context_chars FROM w WHERE contains(text, '(')""",
)
def line_context_window(spark, sf):
    rows = li.with_context(co.detect_language(d.corpus(spark, sf)), 5, 2, where=lambda t: t.contains("("))
    joined = F.array_join("context", "|")
    return rows.select("repo", "path", "line_no", F.md5(joined).alias("context_digest"), F.length(joined).alias("context_chars"))


SQL_CALLS = "|".join(n.replace(".", r"\.") for n in reg.js_sanitizer_names("sql"))


@query(
    "multiline_sql_templates",
    f"""{FILES}, seg AS (SELECT repo, path, content, string_split(content, '`') AS s,
        regexp_extract_all(content, {q(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:" + "|".join(n.replace(".", r"\.") for n in reg.js_sanitizer_names("sql", with_universal=False)) + r")\s*\(")}, 1) AS safe
      FROM files WHERE language <> 'python'),
    one AS (SELECT repo, path, safe, s, unnest(range(2, len(s) + 1)) AS i FROM seg),
    two AS (SELECT repo, path, safe, s[i] AS t, 1 + len(string_split(array_to_string(s[1:i-1], ''), chr(10))) - 1 AS line FROM one WHERE i % 2 = 0)
    SELECT repo, path, line FROM two WHERE contains(t, chr(10)) AND contains(t, '${{') AND {m('t', cat.SQL_WORDS)}
      AND len(list_filter(regexp_extract_all(t, '\\$\\{{([^}}]*)\\}}', 1),
        lambda e: NOT regexp_matches(e, {q(r"^\s*(?:" + SQL_CALLS + r")\s*\(")}) AND NOT list_contains(safe, trim(e)))) > 0""",
)
def multiline_sql_templates(spark, sf):
    return li.multiline_sql_templates(co.detect_language(d.corpus(spark, sf)))


_QUICK_CELLS = ", ".join(
    f"CASE WHEN {m('text', p)} THEN {{'rule': {q(n)}, 'severity': {q(s)}, 'cwe': {q(c)}}} END" for n, s, c, p in cat.QUICK
)


@query(
    "quick_triage_scan",
    f"""{FILES}, h AS (SELECT repo, path, line_no AS line, unnest(list_filter([{_QUICK_CELLS}], lambda x: x IS NOT NULL)) AS h FROM lines),
    z AS (SELECT repo, path, regexp_split_to_array(content, {q(cat.QUICK_TEMPLATE)}) AS p, regexp_extract_all(content, {q(cat.QUICK_TEMPLATE)}, 0) AS mm FROM files),
    y AS (SELECT repo, path, p, mm, unnest(range(1, len(mm) + 1)) AS k FROM z WHERE len(mm) > 0),
    x AS (SELECT DISTINCT repo, path, len(string_split(array_to_string(p[1:k], '') || array_to_string(mm[1:k-1], ''), chr(10))) AS line FROM y)
    SELECT repo, path, line, h.rule AS rule, h.severity AS severity, h.cwe AS cwe FROM h
    UNION ALL
    SELECT repo, path, line, 'SQL injection', 'critical', 'CWE-89' FROM x
    WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.path = x.path AND h.line = x.line AND h.h.rule = 'SQL injection')""",
)
def quick_triage_scan(spark, sf):
    return li.quick_scan(co.detect_language(d.corpus(spark, sf)))


# ------------------------------------------------------------------- taint
END = r"[\w.$]*\s*(?:[;,\n)]|$)"
DECL = r"(?:const|let|var)"


@query(
    "taint_js_sources",
    f"""{FILES}, v AS (
      SELECT path, unnest(regexp_extract_all(content, {q(DECL + r"\s+([A-Za-z_$][\w$]*)\s*=\s*" + fi.JS_INPUT + END)}, 1)) AS variable
      FROM files WHERE language <> 'python'
      UNION ALL
      SELECT path, regexp_extract(x, '^\\s*(?:[\\w$]+\\s*:\\s*)?([A-Za-z_$][\\w$]*)\\s*$', 1) FROM (
        SELECT path, unnest(string_split(g, ',')) AS x FROM (
          SELECT path, unnest(regexp_extract_all(content, {q(DECL + r"\s*\{([^}]*)\}\s*=\s*" + fi.JS_INPUT + END)}, 1)) AS g
          FROM files WHERE language <> 'python')))
    SELECT DISTINCT path, variable FROM v WHERE variable <> ''""",
)
def taint_js_sources(spark, sf):
    f = co.detect_language(d.corpus(spark, sf)).filter(F.col("language") != "python")
    return f.select("path", F.explode(fi.js_tainted(F.col("content"))).alias("variable"))


def _py_query(expr):
    def run(spark, sf):
        f = co.detect_language(d.corpus(spark, sf)).filter(F.col("language") == "python")
        f = f.select("path", lines_of(F.col("content")).alias("l"))
        return f.select("path", F.explode(expr(F.col("l"))).alias("variable"))

    return run


PYFACTS = f"{FILES}, {context_lines()}"
QUERIES["taint_py_sources"] = _py_query(lambda l: fi.py_tainted(l))
ORACLE["taint_py_sources"] = f"{PYFACTS} SELECT DISTINCT path, unnest(src) AS variable FROM facts"
QUERIES["taint_py_sources_web"] = _py_query(lambda l: fi.py_tainted(l, web_only=True, transitive="none"))
ORACLE["taint_py_sources_web"] = f"{PYFACTS} SELECT DISTINCT path, v AS variable FROM asg WHERE {m('rhs', reg.PY_INPUT_WEB)}"
for _c in ("xss", "cmd", "path", "ssrf", "eval"):
    QUERIES[f"taint_py_sanitized_{_c}"] = _py_query(lambda l, c=_c: fi.py_sanitized(l, c))
    ORACLE[f"taint_py_sanitized_{_c}"] = (
        f"{PYFACTS} SELECT DISTINCT path, v AS variable FROM asg WHERE {m('rhs', alternation(reg.py_sanitizer_names(_c)))}"
    )
QUERIES["taint_py_sql_variables"] = _py_query(fi.py_sql_variables)
ORACLE["taint_py_sql_variables"] = f"{PYFACTS} SELECT DISTINCT path, unnest(sqlvars) AS variable FROM facts"


@query(
    "taint_js_sanitized",
    f"""{FILES}, s(name, category) AS (VALUES {', '.join(f"({q(n)}, {q(c)})" for n, cs in reg.JS_SANITIZERS for c in cs if c != 'universal')}),
    decl AS (SELECT path, unnest(regexp_extract_all(content, {q(DECL + r"\s+[A-Za-z_$][\w$]*\s*=\s*[\w.]+\s*\(")})) AS x FROM files WHERE language <> 'python')
    SELECT DISTINCT path, s.category, regexp_extract(x, {q(DECL + r"\s+([A-Za-z_$][\w$]*)")}, 1) AS variable
    FROM decl JOIN s ON s.name = regexp_extract(x, '=\\s*([\\w.]+)\\s*\\($', 1)""",
)
def taint_js_sanitized(spark, sf):
    f = co.detect_language(d.corpus(spark, sf)).filter(F.col("language") != "python")
    pairs = F.concat(*[fi._tag(c, fi.js_sanitized(F.col("content"), c)) for c in ("xss", "sql", "cmd", "path", "ssrf")])
    return f.select("path", F.explode(pairs).alias("p")).select(
        "path", F.col("p.k").alias("category"), F.col("p.v").alias("variable")
    )


def _js_line_sanitizer(c):
    return alternation(reg.js_sanitizer_names(c))


@query(
    "line_sanitizer_test",
    f"{FILES} SELECT path, line_no, language FROM lines WHERE "
    + " OR ".join(
        [f"(language <> 'python' AND {m('text', _js_line_sanitizer(c))})" for c in ("xss", "sql", "cmd", "path", "ssrf")]
        + [f"(language = 'python' AND {m('text', alternation(reg.py_sanitizer_names(c)))})" for c in ("xss", "cmd", "path", "ssrf", "eval")]
    ),
)
def line_sanitizer_test(spark, sf):
    from ..functions.text import rx

    js = sorted({n for n, _ in reg.JS_SANITIZERS})
    py = sorted({n for ns, _ in reg.PY_SANITIZERS for n in ns})
    f = co.detect_language(d.corpus(spark, sf))
    l = f.select("path", "language", F.posexplode(lines_of(F.col("content"))).alias("p", "text"))
    hit = F.when(F.col("language") == "python", rx(F.col("text"), alternation(py))).otherwise(rx(F.col("text"), alternation(js)))
    return l.filter(hit).select("path", (F.col("p") + 1).alias("line_no"), "language")
