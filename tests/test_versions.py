from pyspark.sql import functions as F

from codeassay.operators.advisories import affected_ranges, version_key

ORDERS = {
    "npm": ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "v2.0.0", "10.0.0"],
    "PyPI": ["0.9.dev1", "0.9", "1.0.dev3", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.1", "2.0"],
}


def test_versions_in_order(spark):
    for eco, versions in ORDERS.items():
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(versions)], "i int, v string")
        assert [r.v for r in rows.orderBy(version_key(F.col("v"), F.lit(eco))).collect()] == versions
    same = spark.createDataFrame([("1.0", "1"), ("1.0.0+b5", "1.0"), ("=2.0", "v2")], "a string, b string")
    assert all(r[0] for r in same.select(version_key(F.col("a"), F.lit("npm")) == version_key(F.col("b"), F.lit("npm"))).collect())
    odd = spark.createDataFrame([("latest",), ("",), (None,)], "v string")
    assert [r[0] for r in odd.select(version_key(F.col("v"), F.lit("npm")).isNull()).collect()] == [True] * 3


def test_intervals(spark):
    text = '[{"events":[{"introduced":"0"},{"fixed":"1.2"},{"introduced":"2.0"}]},{"events":[{"fixed":"9"}]},{"events":null}]'
    kind = "array<struct<events:array<struct<introduced:string,fixed:string>>>>"
    row = spark.createDataFrame([(text,)], "t string").select(affected_ranges(F.from_json("t", kind)).alias("r")).first()
    assert [tuple(x) for x in row.r] == [("0", "1.2"), ("2.0", None)]


def test_short_and_long_forms_in_one_order(spark):
    versions = ["0", "0.0.0.0.1", "0.0.1", "0.1", "v0.2-0", "0.2-a", "0.2-a.b", "0.2-a\0", "0.2-a\0b", "0.2-a\1", "0.2", "=1.0.0.0.0.0+x", "1.0.0.0.0.1", "1.0.0.1", "1.999999", "1.1000000", "1.1000000.1", "1.123456789012345678901", "2"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(versions)], "i int, v string")
    key = version_key(F.col("v"), F.lit("npm"))
    assert [r.v for r in rows.orderBy(key).collect()] == versions and rows.select(key.alias("k")).distinct().count() == len(versions)
    assert all(isinstance(r[0], str) for r in rows.select(key).collect())
    same = spark.createDataFrame([("1.2", "v1.2"), ("0", "00.0"), ("1.0.0.0.0", "1"), ("01.2", "1.2.0"), ("0.1.0", "=0.01")], "a string, b string")
    assert all(r[0] for r in same.select(version_key(F.col("a"), F.lit("PyPI")) == version_key(F.col("b"), F.lit("PyPI"))).collect())
