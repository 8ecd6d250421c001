"""Positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.session import cut_lineage
from .joins import hot_keys


def grouped_index(df: DataFrame, group: str, order: list[str], name: str = "idx", buckets: int | None = None) -> DataFrame:
    """0-based position of a row in its group, without gathering a group.

    Without hot groups this is a plain window.  Otherwise rows are
    range-partitioned by (group, order), so a huge group spans many partitions.  Each partition numbers its own rows; the offsets come from the
    small table of counts per (group, partition).  The ranged rows are
    checkpointed because both steps must see the same partitions.
    """
    if buckets is None and not hot_keys(df, [group]):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint") - 1)
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(group), *[F.col(o) for o in order]).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    local = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = ranged.withColumn("_local", F.row_number().over(local) - 1)
    counts = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        numbered.join(offsets, [group, "_part"])
        .withColumn(name, F.col("_local") + F.col("_off"))
        .drop("_part", "_local", "_off")
    )


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    """First n rows per group; Spark prunes each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
