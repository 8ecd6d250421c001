"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16
SAMPLE, HOT_MINIMUM, HOT_KEYS = 0.01, 200, 1000


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys that hold a large share of the rows.

    Found in a one per cent sample of the key columns: a key counts from
    HOT_MINIMUM sampled rows, and only the largest HOT_KEYS are kept, so the
    list is bounded.  It only steers how rows are spread: a missed key or a
    false one changes no result.
    """
    counts = df.select(key_hash(keys).alias("h")).sample(SAMPLE, 7).groupBy("h").agg(F.count("*").alias("n"))
    return most_hashes(counts, None, HOT_MINIMUM)


def most_hashes(counts: DataFrame, keys: list[str] | None, least: int) -> list[int]:
    """Hashes (or column ``h``) of the keys with the most rows, ``n`` at least ``least``, and at most HOT_KEYS of them."""
    big = counts.filter(F.col("n") >= least).select(key_hash(keys).alias("h") if keys else "h", "n")
    return [r["h"] for r in big.orderBy(F.desc("n")).limit(HOT_KEYS).collect()]


def spread_hot(many: DataFrame, keys: list[str], hot: list[int], salts: int = SALTS) -> DataFrame:
    """``many`` with a column ``_salt``: rows of hot keys are dealt over sub-keys, all others have sub-key 0."""
    spread = F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")
    return many.withColumn("_salt", F.when(key_hash(keys).isin(hot), spread).otherwise(F.lit(0)) if hot else F.lit(0))


def copy_hot(few: DataFrame, keys: list[str], hot: list[int], salts: int = SALTS) -> DataFrame:
    """``few`` with a column ``_salt``: rows of hot keys once for each sub-key of ``spread_hot``."""
    copies = F.when(key_hash(keys).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return few.withColumn("_salt", F.explode(copies) if hot else F.lit(0))


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS, hot: list[int] | None = None
) -> DataFrame:
    """Equi-join of a side that may be skewed with a side that has few rows per key.

    Rows of hot keys spread over ``salts`` sub-keys and the matching rows of
    ``few`` are repeated once per sub-key; all other rows join as they are.
    Works for inner and left joins.
    """
    hot = hot_keys(many, keys) if hot is None else hot
    if not hot:
        return many.join(few, keys, how)
    return spread_hot(many, keys, hot, salts).join(copy_hot(few, keys, hot, salts), [*keys, "_salt"], how).drop("_salt")
