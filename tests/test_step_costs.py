"""What a step must not do again: its rows are right, and it moves or sorts them no more often than it says."""

import datetime as dt

from codeassay.operators import advisories as ad, exports as ex, graph as gr
from codeassay.sources import derived as d
from codeassay.streaming import lifetimes as lt


def test_a_timer_that_changes_nothing_gives_no_rows():
    old = {1: ("running", 5)}
    assert list(lt._Lives._changes(("=1",), old, old)) == []
    new = {1: ("running", 4), 2: ("failed", 9)}
    assert [tuple(r) for r in lt._Lives._changes(("=1",), old, new)] == [("=1", 1, "running", 4, False), ("=1", 2, "failed", 9, False)]
    assert [r.asDict() for r in lt._Lives._changes(("=1",), old, {})] == [{"key": "=1", "step": 1, "status": "running", "at_ms": 5, "gone": True}]


PAIR = "ecosystem string, name string, version string"


def snapshot(spark, *documents):
    docs = [
        '{"id":"%s","affected":[{"package":{"name":"%s","ecosystem":"npm"},"ranges":[{"events":[%s]}]}]}' % (i, name, ",".join(f'{{"introduced":"{a}"}},{{"fixed":"{b}"}}' for a, b in spans))
        for i, name, spans in documents
    ]
    return ad.normalise_advisories(ad.parse_advisories(spark.createDataFrame([(x,) for x in docs], "value string")))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_index_gives_a_version_once_for_intervals_that_overlap(spark, monkeypatch):
    used = spark.createDataFrame([("npm", "p", f"{i}.0") for i in range(600)], PAIR)
    advisories = snapshot(spark, ("A", "p", [("10", "400"), ("20", "30"), ("350", "500")]), ("B", "p", [("599", "700"), ("0", "1")]))
    seen = []
    inner = ad.indexed_hits
    monkeypatch.setattr(ad, "indexed_hits", lambda *x: seen.append(inner(*x)) or seen[-1])
    hits = ad.range_hits(used, advisories, direct_pairs=-1)
    want = sorted([("A", f"{i}.0") for i in range(10, 500)] + [("B", "0.0"), ("B", "599.0")])
    assert sorted((r.adv.id, r.version) for r in seen[0].collect()) == want == sorted((r.adv.id, r.version) for r in hits.collect())


def test_the_index_makes_its_inputs_once(spark):
    made = spark.sparkContext.accumulator(0)
    rows = [("npm", "p", f"{i}.0") for i in range(600)]
    used = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(lambda r: made.add(1) or r), PAIR).distinct()
    hits = ad.range_hits(used, snapshot(spark, *((f"A{i}", "p", [(f"{i}", f"{i + 9}")]) for i in range(20))))
    assert hits.count() == 180
    assert made.value == len(rows)


def test_few_intervals_need_no_distinct_over_the_hits(spark):
    used = spark.createDataFrame([("npm", "p", v) for v in ("1.0", "2.0", "9.0", "none")] + [("npm", "q", "1.0")], PAIR)
    advisories = snapshot(spark, ("A", "p", [("0", "3"), ("1.0", "2.5")]), ("B", "p", [("5", "10")]), ("B", "p", [("5", "10")]))
    hits = ad.range_hits(used, advisories)
    assert sorted((r.adv.id, r.version) for r in hits.collect()) == [("A", "1.0"), ("A", "2.0"), ("B", "9.0")]
    assert plan(hits).count("Aggregate") == 1  # the intervals of a package


def test_failed_scans_are_taken_out_once(spark):
    deps = spark.createDataFrame(
        [(s, "npm", "p", "1.0", "m", 1, False) for s in ("a", "b")], "repo string, ecosystem string, name string, version string, source string, line int, dev boolean"
    )
    found = ad.scan_sca(deps, snapshot(spark, ("A", "p", [("0", "3")])), "repo", spark.createDataFrame([("b",), ("b",)], "repo string"))
    assert [(r.repo, r.rule_id) for r in found.collect()] == [("a", "SCA-A")]
    assert plan(found).count("LeftAnti") == 1


def test_the_sequence_of_a_finding_is_as_formatted(spark, tmp_path):
    rows = [
        (1, 2, 3, 4, 5.0, "R", "F", dt.date(1996, 1, 9)),
        (1, None, None, None, None, None, None, None),
    ]
    li = spark.createDataFrame(
        rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate date"
    )
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = d.findings(spark, str(tmp_path)).select("seq")
    assert sorted(r.seq for r in found.collect()) == ["2-3-4-5-RF-19960109", "null-null-null-null-nullnull-null"]
    assert "format_string" not in plan(found)


def test_names_of_documents_need_no_sort(spark):
    deps = spark.createDataFrame([(1, "m", 1, "p", "1.0", "npm", False, None)] * 2, "scan_id bigint, source string, line int, name string, version string, ecosystem string, dev boolean, license string")
    docs = ex.to_sbom(deps, ["source", "line", "name"], scans=spark.createDataFrame([(1,), (2,)], "scan_id bigint"))
    assert sorted((r.scan_id, r.components) for r in ex.sbom_summary(docs).collect()) == [(1, 2), (2, 0)]
    assert "first(" not in plan(docs)


def test_edges_are_shuffled_once(spark, monkeypatch):
    plans, keep = [], type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: plans.append(self._jdf.queryExecution().sparkPlan().toString()) or keep(self, *a))
    e = spark.createDataFrame([("s", "a", "b"), ("s", "a", "b"), ("s", "b", "c")], "repo string, parent_key string, child_key string")
    got = gr.reachability(e, spark.createDataFrame([("s", "a")], "repo string, dep_key string"))
    assert sorted((r.dep_key, r.depth) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert plans[0].index("HashAggregate") < plans[0].index("Exchange")  # equal edges go after the one shuffle, not before another
