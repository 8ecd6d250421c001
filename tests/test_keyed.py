import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from codeassay.operators import sketches as sk
from codeassay.operators.keyed import KeyedTable

SCHEMA = "k string, v string, at int"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    rows = [(f"k{i}", "old", 1) for i in range(2000)] + [(None, "old", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = KeyedTable(str(tmp_path / "t"), df.schema, ("k",), "at", 64).create(spark)
    assert table.read(spark).count() == 0 and table.upsert(df.limit(0)) == 0
    assert table.upsert(df) == 64
    before = files(table.path)
    fresh = [("k7", "new", 2), ("k8", "late", 0), ("k7", "new", 2), ("k7", "also", 2), ("x", None, None), (None, "new", 3)]
    n = table.upsert(spark.createDataFrame([(*r, 1) for r in fresh], SCHEMA + ", other int"))
    after = files(table.path)
    assert n <= 4 and len({Path(p).parent for p in before if after.get(p) != before[p]}) <= n
    assert sum(after.get(p) == t for p, t in before.items()) >= 0.9 * len(before)
    got = {r["k"]: (r["v"], r["at"]) for r in table.read(spark).collect()}
    assert len(got) == 2002 and got["k7"] == ("new", 2) and got["k8"] == ("old", 1) and got["x"] == (None, None) and got[None] == ("new", 3)
    assert table.create(spark).upsert(spark.createDataFrame(fresh, SCHEMA)) == n and {r["k"]: (r["v"], r["at"]) for r in table.read(spark).collect()} == got


def test_sketches_of_days_merge(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1 + d // 28, 1 + d % 28)
    rows = [(d % 3, f"f{(d * 7919 + i) % 9000}", t(d)) for d in range(56) for i in range(400)] + [(0, None, t(3)), (0, "x", None)]
    df = spark.createDataFrame(rows, "repo int, file string, created_at timestamp")
    made = sk.daily_sketches(df, [F.col("file")], ["repo"])
    sk.write_days(made, str(tmp_path / "s"))
    sk.write_days(made.filter("day = DATE'2024-01-05'"), str(tmp_path / "s"))  # a day that is written again replaces itself
    days = spark.read.schema(made.schema).parquet(str(tmp_path / "s"))
    for by in ([F.col("repo")], [F.trunc("day", "month").alias("m")], []):
        got = {tuple(r)[:-2]: tuple(r)[-2:] for r in sk.distinct_of(days, by).collect()}
        exact = df.withColumn("day", F.to_date("created_at")).groupBy(*by).agg(F.size(F.collect_set(F.coalesce("file", F.lit("null")))), F.count("*"))
        for r in exact.collect():
            n, total = got[tuple(r)[:-2]]
            assert total == r[-1] and abs(n - r[-2]) <= 5 * sk.standard_error() * r[-2]
