"""Distinct counts from stored sketches: a day is counted once, any period is merged from its days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Registers of a sketch: 2 ** LG_K.
LG_K = 12


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / math.sqrt(1 << lg_k)


def daily_sketches(rows: DataFrame, what: list[Column], keys: list[str], at: str = "created_at", lg_k: int = LG_K) -> DataFrame:
    """(keys, day, sketch, n_rows): a HyperLogLog sketch of the distinct ``what`` of each day, some kilobytes whatever it counts.

    Sketches are built before the shuffle and merged after it.  A part of
    ``what`` may be null and is a value; rows without a time have the day null.
    """
    value = F.to_json(F.struct(*[x.alias(f"v{i}") for i, x in enumerate(what)]))
    day = F.to_date(at).alias("day")
    return rows.groupBy(*keys, day).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"), F.count("*").alias("n_rows"))


def write_days(sketches: DataFrame, path: str) -> None:
    """Stores the sketches by day; days that are written again replace themselves, others stay."""
    out = sketches.repartition(F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("day").parquet(path)


def distinct_of(sketches: DataFrame, by: list[Column]) -> DataFrame:
    """Estimated distinct values and exact rows of each group of ``by``, from sketches of one size."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"), F.sum("n_rows").alias("n_rows"))
