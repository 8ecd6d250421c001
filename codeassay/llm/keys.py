"""Rows named by key and text, and rows taken out of a table without moving the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Values that a filter before a join may take; bounds what it broadcasts.
FILTER_VALUES = 1 << 20


def fresh(name: str, df: DataFrame) -> str:
    """A name that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key(key: str, text: str) -> Column:
    """A string for (key, text) that sorts by the key where that is a number from 0; only rows that repeat both share it."""
    of = F.lpad(F.hex(F.col(key).cast("bigint")), 16, "0")
    return F.concat(F.coalesce(of, F.lit("")), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def value_class(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_VALUES))


def classes(values: DataFrame, column: str) -> DataFrame:
    """The classes that the values of a column fall in: FILTER_VALUES rows at most, so they may be broadcast."""
    return F.broadcast(values.select(value_class(column).alias("_class")).distinct())


def without(df: DataFrame, column: str, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``df`` without rows whose ``column`` is in ``gone``; of rows that share a value of ``once`` one stays.

    ``column`` has no nulls.  Only rows of a class that some such value has are
    shuffled, the others stay where they are.
    """
    named = gone.select(F.col(column).alias("_value"), F.lit(True).alias("_gone"))
    if once is not None:
        named = named.union(once.select(F.col(column).alias("_value"), F.lit(False).alias("_gone")))
    marked = df.withColumn("_class", value_class(column))
    touched = classes(named, "_value")
    safe = marked.join(touched, "_class", "left_anti").drop("_class")
    near = marked.join(touched, "_class", "left_semi").drop("_class").join(named.filter("_gone"), F.col(column) == F.col("_value"), "left_anti")
    return safe.union(near.dropDuplicates([column]) if once is not None else near)
