import json

from pyspark.sql import functions as F

from codeassay.operators import exports as ex


def whole(fragments):
    out = {}
    for r in fragments.orderBy("scan_id", "place").collect():
        out[r.scan_id] = out.get(r.scan_id, "") + r.text
    return {k: json.loads(x) for k, x in out.items()}


def test_documents_of_any_size_have_one_form(spark):
    n = 12_000
    findings = spark.range(n).select(
        F.lit(1).alias("scan_id"), F.col("id").alias("seq"), F.concat(F.lit("R"), (F.col("id") % 7).cast("string")).alias("rule_id"), F.lit("name").alias("rule_name"),
        F.lit("critical").alias("severity"), F.lit("m").alias("message"), F.lit("a.js").alias("file_path"), (F.col("id") + 1).cast("int").alias("line"), F.lit(1).alias("column"),
        F.lit("x").alias("snippet"), F.lit("fix").alias("suggestion"), F.lit("CWE-1").alias("cwe"), F.lit("A01").alias("owasp"),
    )
    run = whole(ex.to_sarif(findings, ["seq"]))[1]["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == [f"R{i}" for i in range(7)]
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]] == list(range(1, n + 1))
    assert ex.sarif_summary(ex.to_sarif(findings, ["seq"])).first()["critical"] == n
    name = "@" + "n" * 11_000
    deps = spark.range(n).select(
        F.lit(1).alias("scan_id"), F.col("id").alias("k"), F.lit("npm").alias("ecosystem"), F.when(F.col("id") == 0, name).otherwise("p").alias("name"),
        F.col("id").cast("string").alias("version"), F.lit(None).cast("string").alias("license"), F.lit(False).alias("dev"),
    )
    bom = whole(ex.to_sbom(deps, ["k"]))[1]
    assert len(bom["components"]) == n and bom["components"][0]["purl"] == f"pkg:npm/%40{name[1:]}@0" and bom["metadata"]["component"]["name"] == "1"


def test_appended_findings_are_few_files(spark, tmp_path):
    rows = spark.range(4000).repartition(16).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo"), F.lit("f").alias("file_path"), F.col("id").cast("int").alias("line"))
    ex.write_findings(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000
    assert all(len(list(x.glob("*.parquet"))) <= ex.FILES for x in (tmp_path / "t").glob("repo=*"))


def test_clean_scans_have_documents(spark):
    scans = spark.createDataFrame([(1,), (2,), (3,), (3,)], "scan_id bigint")
    findings = spark.createDataFrame(
        [(1, 0, "R", "n", "critical", "m", "a.js", 1, 1, "x", "fix", "CWE-1", "A01")],
        "scan_id bigint, seq int, rule_id string, rule_name string, severity string, message string, file_path string, line int, column int, snippet string, suggestion string, cwe string, owasp string",
    )
    fragments = ex.to_sarif(findings, ["seq"], scans)
    documents = whole(fragments)
    assert set(documents) == {1, 2, 3} and documents[2] == documents[3]
    assert documents[2]["runs"][0]["results"] == [] and documents[2]["runs"][0]["tool"]["driver"]["rules"] == [] and documents[2]["version"] == "2.1.0"
    assert sorted(tuple(r) for r in ex.sarif_summary(fragments).collect()) == [(1, 1, 1, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    assert set(whole(ex.to_sarif(findings, ["seq"]))) == {1} and set(whole(ex.to_sarif(findings.limit(0), ["seq"], scans))) == {1, 2, 3}
    deps = spark.createDataFrame([(1, 0, "npm", "p", "1.0", None, False)], "scan_id bigint, k int, ecosystem string, name string, version string, license string, dev boolean")
    bills = whole(ex.to_sbom(deps, ["k"], scans=scans))
    assert [len(bills[i]["components"]) for i in (1, 2, 3)] == [1, 0, 0] and bills[3]["metadata"]["component"]["name"] == "3"
