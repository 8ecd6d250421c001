"""The interval index gives what comparing every version with every interval gives."""

import random

import pytest

from codeassay.operators import advisories as ad


def snapshot(spark, rng, packages, intervals):
    v = lambda: f"{rng.randrange(4)}.{rng.randrange(6)}.{rng.randrange(3)}"
    docs = []
    for i in range(intervals):
        events = rng.choice([
            f'{{"introduced":"{v()}"}},{{"fixed":"{v()}"}}', f'{{"introduced":"{v()}"}}', f'{{"introduced":"0"}},{{"fixed":"{v()}"}}', '{"introduced":"0"}',
            f'{{"introduced":"word"}},{{"fixed":"{v()}"}}', f'{{"introduced":"{v()}"}},{{"fixed":"word"}}',
        ])
        docs.append((f'{{"id":"A{i}","affected":[{{"package":{{"name":"p{rng.randrange(packages)}","ecosystem":"npm"}},"ranges":[{{"events":[{events}]}}]}}]}}',))
    return ad.normalise_advisories(ad.parse_advisories(spark.createDataFrame(docs, "value string")))


def versions(spark, rng, packages, n):
    rows = {("npm", f"p{rng.randrange(packages)}", rng.choice([f"{rng.randrange(5)}.{rng.randrange(7)}.{rng.randrange(3)}", f"{rng.randrange(4)}.{rng.randrange(6)}", "none"])) for _ in range(n)}
    return spark.createDataFrame(sorted(rows), "ecosystem string, name string, version string")


@pytest.mark.parametrize("packages, intervals, n", ((1, 60, 150), (5, 80, 200), (40, 60, 100)))
def test_like_comparing_all(spark, packages, intervals, n):
    rng = random.Random(packages)
    advisories, used = snapshot(spark, rng, packages, intervals), versions(spark, rng, packages, n)
    found = lambda most: sorted((r.name, r.version, r.adv.id) for r in ad.range_hits(used, advisories, direct_pairs=most).collect())
    direct = found(1 << 60)
    assert direct and found(-1) == direct == found(200)


def test_nothing_to_compare(spark):
    rng = random.Random(0)
    advisories, used = snapshot(spark, rng, 3, 10), versions(spark, rng, 3, 10)
    assert ad.range_hits(used.limit(0), advisories, -1).count() == 0 and ad.range_hits(used, advisories.limit(0), -1).count() == 0


def test_skipped_scans(spark):
    deps = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "repo string, name string")
    advisories, failed = snapshot(spark, random.Random(0), 3, 10), spark.createDataFrame([("b",), ("b",)], "repo string")
    got = lambda *x: sorted((r.repo, r.dep_count, r.skipped) for r in ad.sca_metrics(deps, *x).collect())
    assert got(advisories) == [("a", 2, False), ("b", 1, False)]
    assert got(advisories, "repo", failed) == [("a", 2, False), ("b", 1, True)]
    assert got(None) == got(advisories.limit(0)) == [("a", 2, True), ("b", 1, True)]


def test_hot_packages_and_long_segments(spark, monkeypatch):
    """Versions dealt over copies of the bounds, few of them together, and null names on both sides."""
    monkeypatch.setattr(ad, "HOT_VERSIONS", 30)
    monkeypatch.setattr(ad, "TOGETHER", 3)
    monkeypatch.setattr(ad, "SENT_PACKAGES", 1)
    rng = random.Random(9)
    advisories, used = snapshot(spark, rng, 3, 90), versions(spark, rng, 3, 150)
    odd = spark.createDataFrame([("npm", None, "1.0"), (None, "p0", "1.0"), ("npm", "p0", None)], used.schema)
    none = ad.normalise_advisories(ad.parse_advisories(spark.createDataFrame([('{"id":"N","affected":[{"package":{"ecosystem":"npm"},"ranges":[{"events":[{"introduced":"0"}]}]}]}',)], "value string")))
    found = lambda most: sorted((r.name, r.version, r.adv.id) for r in ad.range_hits(used.unionByName(odd), advisories.unionByName(none), direct_pairs=most).collect())
    assert found(-1) == found(1 << 60) != []


def test_a_package_without_bounds(spark):
    docs = [(f'{{"id":"A{i}","affected":[{{"package":{{"name":"p","ecosystem":"npm"}},"ranges":[{{"events":[{{"introduced":"0"}}]}}]}}]}}',) for i in range(2)]
    advisories = ad.normalise_advisories(ad.parse_advisories(spark.createDataFrame(docs, "value string")))
    used = spark.createDataFrame([("npm", "p", v) for v in ("1", "2.0", "none")], "ecosystem string, name string, version string")
    got = sorted((r.version, r.adv.id) for r in ad.range_hits(used, advisories, direct_pairs=-1).collect())
    assert got == [("1", "A0"), ("1", "A1"), ("2.0", "A0"), ("2.0", "A1")]
