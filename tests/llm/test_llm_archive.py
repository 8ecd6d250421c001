from pyspark.sql import functions as F

from codeassay.llm import archive


def leaves(spark, rows, per_file=5):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return archive.archived(pages.withColumn("place", F.lit("x")), file_records=per_file)


ROWS = [(i, f"http://h/{i}", f"<p>é {i}</p>" * (i % 4)) for i in range(23)] + [(None, None, None), (7, "http://h/7", None), (7, "http://h/7", None)]


def test_equal_replicas_and_roots(spark):
    a = leaves(spark, ROWS)
    assert a.count() == len(ROWS)
    assert archive.damage(a, leaves(spark, ROWS[::-1]), 5).count() == 0
    roots = archive.file_roots(a, 5).collect()
    assert len(roots) == 6 and sum(r["bytes"] for r in roots) == a.agg(F.sum("length")).first()[0]
    for own in a.collect():
        assert own["end"] - own["start"] == own["length"]


def test_kinds(spark):
    a = leaves(spark, ROWS)
    broken = [(i, u, "#" + h[1:] if i == 3 else h) for i, u, h in ROWS]
    found = archive.damage(a, leaves(spark, broken), 5).collect()
    assert [(r["key"], r["kind"], r["start_a"] == r["start_b"]) for r in found] == [(3, "corrupt", True)]
    longer = [(i, u, h + "!!" if i == 3 else h) for i, u, h in ROWS]
    found = {r["key"]: r["kind"] for r in archive.damage(a, leaves(spark, longer), 5).collect()}
    place = {r["key"]: (r["file"], r["place"]) for r in a.filter("key is not null and key <> 7").collect()}
    assert found == {3: "corrupt"} | {k: "moved" for k, (f, p) in place.items() if f == place[3][0] and p > place[3][1]}
    last = a.filter("not (file = 2 and place >= 3)")
    assert [r["kind"] for r in archive.damage(a, last, 5).collect()] == ["missing"] * 2
    assert [r["kind"] for r in archive.damage(last, a, 5).collect()] == ["extra"] * 2
    assert archive.damage(a, a.limit(0), 5).count() == len(ROWS) and archive.damage(a.limit(0), a.limit(0), 5).count() == 0


def test_sound_branches_are_not_descended(spark):
    rows = [(i, f"u{i}", "x") for i in range(64)]
    a, b = leaves(spark, rows, 64), leaves(spark, [(i, u, "y" if i == 40 else h) for i, u, h in rows], 64)
    one, two = archive.tree(a, 64, 4), archive.tree(b, 64, 4)
    assert len(one) == 4 and [x.count() for x in one] == [64, 16, 4, 1]
    found = archive.audit(one, two, 4)
    assert [(r["file"], r["place"]) for r in found.collect()] == [(0, 40)]


def test_only_folders_with_a_mismatch_are_read(spark):
    rows = [(i, f"u{i}", "x") for i in range(200)]
    a, b = leaves(spark, rows, 4), leaves(spark, [(i, u, "y" if i == 41 else h) for i, u, h in rows], 4)
    one, two = archive.tree(a, 4, 2), archive.tree(b, 4, 2)
    assert [x.count() for x in one] == [200, 100, 50] and one[0].select("group").distinct().count() == archive.GROUPS

    def only(x):  # the folder of file 10, as if all others were lost
        folder = next(f.rsplit("/", 1)[0] for f in x.inputFiles() if "/group=10/" in f)
        return spark.read.schema(x.schema).option("basePath", folder.rsplit("/", 1)[0]).parquet(folder)

    one, two = ([only(x) for x in side[:-1]] + side[-1:] for side in (one, two))
    assert one[0].count() == 8
    assert [(r["file"], r["place"]) for r in archive.audit(one, two, 2).collect()] == [(10, 1)]


def test_record_bytes(spark):
    row = spark.createDataFrame([("http://é", "<b>ü</b>"), (None, None)], "u string, h string").select(archive.warc_record(F.col("u"), F.col("h")).alias("r")).collect()
    assert bytes(row[0]["r"]).decode() == "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://é\r\nContent-Length: 9\r\n\r\n<b>ü</b>\r\n\r\n"
    assert bytes(row[1]["r"]).decode().endswith("Content-Length: 0\r\n\r\n\r\n\r\n")
