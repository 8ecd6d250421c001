"""Fixity audit of WARC files by Merkle trees.

Records of an archive lie in files one after another.  A leaf is the hash of a
record with its range of offsets; a node is the hash of up to ``fanout`` nodes in
order, so it covers one range of its file.  Two replicas are compared from the
roots down: only children of nodes that differ are looked at, so sound files
cost one comparison.  Each level is stored once, in folders by groups of files;
below the roots only the folders of groups with a mismatch are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.session import cut_lineage, scratch_path
from ..operators.ranking import grouped_index

FANOUT = 16
FILE_RECORDS = 1024
#: Folders of a stored level, by the number of the file, and Parquet files that one may have.
GROUPS, FILES = 32, 8


def warc_record(url: Column, body: Column) -> Column:
    """Bytes of a response record; null parts are empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def record_digests(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, url, body_bytes, digest, length) of each page's record; bodies do not leave the scan."""
    record = warc_record(F.col(url), F.col(body))
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("bigint").alias("length"))


def dealt_to_files(records: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """Adds ``file`` and ``place``: records in the order of key, url and digest (nulls first), so many to a file.

    Positions come from ranges and offsets, so no task sees all records.
    """
    buckets = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = grouped_index(records.withColumn("_all", F.lit(0)), "_all", ["key", "url", "digest"], "_i", buckets).drop("_all")
    return at.withColumn("file", F.floor(F.col("_i") / file_records)).withColumn("place", F.col("_i") % file_records).drop("_i")


def leaves(records: DataFrame) -> DataFrame:
    """(file, place, digest, start, end, hash): record hashes bound to their offsets. A file has a bounded number of records."""
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(before), F.lit(0))
    at = records.withColumn("start", start).withColumn("end", F.col("start") + F.col("length"))
    return at.withColumn("hash", F.sha2(F.concat_ws(":", "digest", "start", "end"), 256))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Nodes one level up: hash of at most ``fanout`` children in order, and the range that they cover."""
    children = F.array_sort(F.collect_list(F.struct("place", "hash")))
    up = nodes.groupBy("file", F.floor(F.col("place") / fanout).alias("place"))
    up = up.agg(children.alias("below"), F.min("start").alias("start"), F.max("end").alias("end"))
    return up.withColumn("hash", F.sha2(F.concat_ws("", F.col("below.hash")), 256)).drop("below")


def group_of(file: Column) -> Column:
    return F.pmod(file, F.lit(GROUPS)).cast("int")


def stored(nodes: DataFrame, path: str) -> DataFrame:
    """``nodes`` with their ``group``, written to a folder for each group and read again."""
    named = nodes.withColumn("group", group_of(F.col("file")))
    spread = named.repartition(F.col("group"), F.floor(F.col("file") / GROUPS) % FILES)
    spread.sortWithinPartitions("group", "file", "place").write.partitionBy("group").parquet(path)
    return nodes.sparkSession.read.schema(named.schema).parquet(path)


def tree(leaf: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> list[DataFrame]:
    """Stored levels of the trees of all files, leaves (with all their columns) first, until each file has one root."""
    path = scratch_path(leaf.sparkSession, "merkle")
    levels, width = [stored(leaf, f"{path}/level-0")], file_records
    while width > 1:
        levels.append(stored(parents(levels[-1], fanout), f"{path}/level-{len(levels)}"))
        width = -(-width // fanout)
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, place, group) and both replicas' start, end and hash of the leaves that differ, found from the roots down."""
    branches: DataFrame | None = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if branches is not None:  # only children of differing nodes, from the folders that hold any
            groups = [r["group"] for r in branches.select("group").distinct().collect()]  # at most GROUPS numbers
            near = branches.select("group", "file", F.col("place").alias("above"))
            a, b = (
                x.filter(F.col("group").isin(groups)).withColumn("above", F.floor(F.col("place") / fanout)).join(near, ["group", "file", "above"], "left_semi") for x in (a, b)
            )
        one = a.select("group", "file", "place", *[F.col(c).alias(f"{c}_a") for c in ("start", "end", "hash")])
        two = b.select("group", "file", "place", *[F.col(c).alias(f"{c}_b") for c in ("start", "end", "hash")])
        branches = cut_lineage(one.join(two, ["group", "file", "place"], "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))))
    return branches


def damage(ours: DataFrame, theirs: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """Every record whose replica differs: its file, place, key, offsets and digests of both, and what is wrong.

    ``ours`` and ``theirs``: (file, place, key, digest, start, end, hash), see
    ``leaves``.  Kinds: ``missing`` in theirs, ``extra`` in theirs, ``corrupt``
    (other bytes), ``moved`` (the same bytes elsewhere).  Equal replicas, also
    empty ones, give no rows.
    """
    one, two = tree(ours, file_records), tree(theirs, file_records)
    found = audit(one, two).select("group", "file", "place")
    groups = [r["group"] for r in found.select("group").distinct().collect()]
    sides = [x.filter(F.col("group").isin(groups)).join(found, ["group", "file", "place"], "left_semi").select("file", "place", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "digest", "start", "end")]) for x, s in ((one[0], "a"), (two[0], "b"))]
    both = reduce(lambda x, y: x.join(y, ["file", "place"], "full"), sides)
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").when(F.col("digest_a") != F.col("digest_b"), "corrupt").otherwise("moved")
    return both.select(
        "file", "place", F.coalesce("key_a", "key_b").alias("key"), F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b"), "digest_a", "digest_b", kind.alias("kind")
    )


def file_roots(leaf: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, bytes, root): what a replica is compared by."""
    return tree(leaf, file_records)[-1].select("file", F.col("end").alias("bytes"), F.col("hash").alias("root"))


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """Leaves of the archive that ``pages`` make, stored in the shared folder.

    Null keys come first, null urls and bodies are empty; repeated rows are
    records of their own.  Other columns are not carried.
    """
    return cut_lineage(leaves(dealt_to_files(record_digests(pages, key, url, body), file_records)))
