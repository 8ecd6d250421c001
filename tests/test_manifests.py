from pyspark.sql import functions as F

from codeassay.operators import advisories as ad, graph as gr, licenses as lc
from codeassay.operators.manifests import clean_version, lock_entries, parse_manifests


def deps(files, path, content):
    rows = parse_manifests(files((path, content))).collect()
    return sorted((r.name, r.version, r.line, r.dev) for r in rows)


def test_formats(files):
    assert deps(files, "x/requirements.txt", "# c\nDjango==3.2\nreq[x] == 1.0 ; y\n-r a\nz>=1\n") == [("django", "3.2", 2, False), ("req", "1.0", 3, False)]
    assert deps(files, "package.json", '{"dependencies": {\n"a": "^1.2.3",\n"b": "*"},\n"devDependencies": {"c": "2.0.0"}}') == [("a", "1.2.3", 2, False), ("c", "2.0.0", 4, True)]
    assert deps(files, "package.json", '{"dependencies": {"a": "1.2.3"') == []
    lock1 = '{"dependencies": {"a": {"version": "1.0.0", "dependencies": {"b": {"version": "2.0.0", "dev": true, "dependencies": {"c": {"version": "3.0.0"}}}}}, "n": {}}}'
    assert deps(files, "package-lock.json", lock1) == [("a", "1.0.0", 1, False), ("b", "2.0.0", 1, True), ("c", "3.0.0", 1, False)]
    lock2 = '{"packages": {"": {"version": "0"}, "node_modules/@s/a": {"version": "1.0.0"}, "node_modules/x/node_modules/b": {"version": "2.0.0", "dev": true}}}'
    assert deps(files, "package-lock.json", lock2) == [("@s/a", "1.0.0", 1, False), ("b", "2.0.0", 1, True)]
    yarn = '# v1\n\n"@s/a@^1":\n  version "1.0.1"\n\nb@^2, b@~2:\n  version "2.0.0"\nb@2:\n  version "2.0.0"\n'
    assert deps(files, "yarn.lock", yarn) == [("@s/a", "1.0.1", 3, False), ("b", "2.0.0", 6, False)]
    assert deps(files, "go.mod", "module m\nrequire g.io/a v1.0.0\nrequire (\n\tg.io/b v2.0.0 // indirect\n\t// g.io/c v1\n)\n") == [("g.io/a", "v1.0.0", 2, False), ("g.io/b", "v2.0.0", 4, False)]
    cargo = '[package]\nname = "m"\n[dependencies]\na = "^1.0"\nb = { version = "2.1", features = [] }\n[build-dependencies]\nc = "0.3"\n[x]\nd = "1.0"'
    assert deps(files, "Cargo.toml", cargo) == [("a", "1.0", 4, False), ("b", "2.1", 5, False), ("c", "0.3", 7, True)]
    assert deps(files, "Cargo.lock", 'version = 3\n\n[[package]]\nname = "a"\nversion = "1.0.0"\n\n[[package]]\nname = "a"\nversion = "1.0.0"\n') == [("a", "1.0.0", 3, False), ("a", "1.0.0", 7, False)]
    assert deps(files, "other.txt", "a==1.0") == []


def test_once_per_file_and_state_of_blocks(files):
    """A file that is given twice reports a package once where its format does; other formats report what each copy holds."""
    sums, pins = ("go.sum", "a v1.0.0 h1:x=\nb v1.0.0 h1:x=\na v1.0.0 h1:x="), ("requirements.txt", "a==1.0\n a==1.0 ")
    found = parse_manifests(files(sums, sums, pins, pins))
    assert sorted((r.source, r.name, r.line, list(r.ord)) for r in found.collect()) == sorted(
        [("go.sum", "a", 1, [0]), ("go.sum", "b", 2, [1])] + 2 * [("requirements.txt", "a", 1, [0]), ("requirements.txt", "a", 2, [1])]
    )
    mod = ")\na v1\nrequire (\nb v1\nrequire (\nc v1\nrequire d v1\n)\ne v1\n require (\t\nf v1"
    assert deps(files, "go.mod", mod) == [("b", "v1", 4, False), ("c", "v1", 6, False), ("d", "v1", 7, False), ("f", "v1", 11, False)]


def test_what_a_file_shares_is_found_once(files):
    """The loops over entries hold no JSON parser, lines are trimmed once, and first occurrences need no sort."""
    found = parse_manifests(files(("package.json", '{"dependencies": {\n"a": "^1.2.3"}}')))
    loops = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode" in x]
    assert len(loops) == 2 and not any("from_json" in x for x in loops)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_are_built_in_as_many_tasks_as_asked_for(spark, tmp_path):
    from codeassay.sources import derived_manifests as dm

    spark.range(4000).selectExpr(
        "id div 4 AS l_orderkey", "id % 50 AS l_partkey", "id % 7 AS l_suppkey", "cast(id % 4 AS int) AS l_linenumber", "if(id % 3 = 0, 'F', 'O') AS l_linestatus"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    built = dm.manifests(spark, str(tmp_path))
    assert built.count() == 1000
    assert built.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_nested_locks(files):
    """Any depth in one pass without a shuffle, repeated names, values that are no text, texts that are no lock files."""
    deep = '{"version": "1.0", "dependencies": {"n%d": ' * 60 % tuple(range(60)) + '{"version": "2.0"}' + "}}" * 60
    texts = ['{"dependencies": {"top": %s}}' % deep, '{"dependencies": {"a": {"version": 3, "requires": {"b": 1, "b": "2"}}, "a": {"version": "4"}, "c": {"version": null}, "d": 5}}']
    texts += ["", "[1]", '{"dependencies": []}', '{"dependencies": {"a": {"version": "1"}}', '{"packages": {}, "dependencies": {"a": {"version": "1"}}}', '{"packages": 7, "dependencies": {"a": {"version": "1", "dev": "x"}}}']
    entries = lock_entries(files(*((f"{i}/package-lock.json", t) for i, t in enumerate(texts))))
    rows = {}
    for r in entries.collect():
        rows.setdefault(r.path[0], []).append((list(r.ord), r.name, r.version, r.dev, [tuple(c) for c in r.children]))
    assert sorted(rows["0"]) == [([0] * (i + 1), "top" if not i else f"n{i - 1}", "1.0" if i < 60 else "2.0", False, []) for i in range(61)]
    assert sorted(rows["1"]) == [([0], "a", "3", False, [("b", "1"), ("b", "2")]), ([1], "a", "4", False, [])]
    assert set(rows) <= {"0", "1", "7"}
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString()


def test_clean_version(spark):
    raw = ["^1.2.3", ">=1.0", "1", "*", "latest", "~ 2.1", "v1.0"]
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(clean_version(F.col("r")).alias("v"))
    assert [x.v for x in df.collect()] == ["1.2.3", "1.0", None, None, None, "2.1", None]


def test_advisories_and_licences(spark):
    doc = '{"id":"A1","aliases":["X","CVE-1"],"severity":[{"type":"CVSS_V3","score":"7.5"}],"affected":[{"package":{"name":"a","ecosystem":"npm"},"ranges":[{"events":[{"introduced":"0"},{"fixed":"2.0.0"}]}],"versions":["1.0.0"]}]}'
    adv = ad.normalise_advisories(ad.parse_advisories(spark.createDataFrame([(doc,)], "value string")))
    dep = spark.createDataFrame(
        [("r", "a", "1.0.0", "npm", "package.json", 3, True, "MIT OR GPL-3.0"), ("r", "b", "1.0.0", "npm", "package.json", 4, False, None)],
        "repo string, name string, version string, ecosystem string, source string, line int, dev boolean, license string",
    )
    f = ad.scan_sca(dep, adv).collect()
    assert [(x.rule_id, x.severity, x.line) for x in f] == [("SCA-A1", "critical", 3)]
    assert f[0].message == "a@1.0.0 (dev) has a known vulnerability: No summary available (CVE-1)"
    assert f[0].suggestion.endswith("Run: npm install a@2.0.0 --save-dev")
    assert ad.scan_sca(dep, adv.limit(0)).count() == 0
    assert [(x.rule_id, x.severity) for x in lc.license_findings(dep).collect()] == [("LICENSE-COPYLEFT", "critical")]


def test_imports(files):
    # a bare import swallows text up to a later "from", so it stands last here
    code = "import x from 'lodash/fp';\nconst e = require('express');\nimport('./local');\nimport { z } from '/abs';\nimport '@a/b/c';"
    rows = gr.imports(files(("a.ts", code), ("b.py", "import os.path\nfrom flask.x import y\n  import no"))).collect()
    assert {r.package for r in rows} == {"lodash", "@a/b", "express", "os", "flask"}


def test_repository_scan(spark, files):
    from codeassay.plans.repository import repository_scan

    lock = '{"packages": {"": {}, "node_modules/a": {"version": "1.0.0", "license": "GPL-3.0", "dependencies": {"b": "^1"}}, "node_modules/b": {"version": "1.0.0"}, "node_modules/c": {"version": "1.0.0"}}}'
    corpus = files(("src/x.js", "import a from 'a';\neval(q);"), ("package-lock.json", lock))
    doc = '{"id":"A%s","affected":[{"package":{"name":"%s","ecosystem":"npm"},"versions":["1.0.0"]}]}'
    adv = ad.normalise_advisories(ad.parse_advisories(spark.createDataFrame([(doc % (n, n),) for n in "bc"], "value string")))
    out = repository_scan(corpus, adv)
    rows = {(r.rule_id, r.severity, r.reachable) for r in out["findings"].collect()}
    assert rows == {("SG-023", "critical", None), ("SCA-Ab", "warning", True), ("SCA-Ac", "warning", False), ("LICENSE-COPYLEFT", "critical", None)}
    assert [(m.dep_count, m.skipped) for m in out["metrics"].collect()] == [(3, False)]


def test_read_corpus(spark, tmp_path):
    from codeassay.operators.corpus import read_corpus

    for name, text in (("a.js", "eval(x)"), ("node_modules/b.js", "y"), ("c.md", "z"), ("package.json", "{}")):
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = {r.path.rsplit("/", 1)[-1]: (r.content, r.size) for r in read_corpus(spark, str(tmp_path / "repo"), repo="r").collect()}
    assert rows == {"a.js": ("eval(x)", 7), "package.json": ("{}", 2)}
