"""Results must not depend on how hot keys are spread."""

import random

from pyspark.sql import functions as F

from codeassay.operators import graph as gr, joins, ranking


def test_salted_join_equals_plain_join(spark):
    rnd = random.Random(1)
    many = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}", i) for i in range(2000)], "k string, i int")
    few = spark.createDataFrame([("hot", 1), ("hot", 2)] + [(f"k{j}", j) for j in range(30)], "k string, v int")
    hot = [many.filter("k = 'hot'").select(joins.key_hash(["k"]).alias("h")).first().h]
    for how in ("inner", "left"):
        plain = sorted(map(tuple, many.join(few, ["k"], how).collect()), key=str)
        salted = sorted(map(tuple, joins.salted_join(many, few, ["k"], how, hot=hot).collect()), key=str)
        assert plain == salted


def test_hot_keys_are_found(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    expected = spark.range(1).select(F.lit(0).cast("bigint").alias("k")).select(joins.key_hash(["k"]).alias("h")).first().h
    assert joins.hot_keys(df, ["k"]) == [expected]


def test_grouped_index_equals_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, F.lit("big")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.hash("id").alias("o"), "id")
    spread = {(r.g, r.id): r.idx for r in ranking.grouped_index(df, "g", ["o", "id"], buckets=7).collect()}
    plain = {(r.g, r.id): r.idx for r in ranking.grouped_index(df, "g", ["o", "id"]).collect()}
    assert spread == plain


def test_reachability_with_cycle_and_hub(spark):
    edges = [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "x", "y"), ("t", "a", "z")] + [("s", "c", f"h{i}") for i in range(500)]
    e = spark.createDataFrame(edges, "repo string, parent_key string, child_key string")
    seeds = spark.createDataFrame([("s", "a")], "repo string, dep_key string")
    got = {(r.repo, r.dep_key) for r in gr.reachability(e, seeds).collect()}
    assert got == {("s", k) for k in ["a", "b", "c"] + [f"h{i}" for i in range(500)]}


def test_chains_stop_at_depth_and_cycles(spark):
    e = spark.createDataFrame(
        [("s", "root", "m"), ("s", "m", "t"), ("s", "other", "t"), ("s", "t", "m")], "repo string, parent_key string, child_key string"
    )
    t = spark.createDataFrame([("s", "t")], "repo string, dep_key string")
    rows = sorted((r["rank"], r.chain) for r in gr.dep_chains(e, t).collect())
    assert rows == [(1, ["t", "other"]), (2, ["t", "m", "root"])]
