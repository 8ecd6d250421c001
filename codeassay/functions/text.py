"""Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from .regex import spark_regex


def rx(col: Column, pattern: str) -> Column:
    """``rlike`` with ASCII word boundaries."""
    return col.rlike(spark_regex(pattern))


def rx_group(col: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, or NULL when there is no match (or an empty group)."""
    return F.nullif(F.regexp_extract(col, spark_regex(pattern), group), F.lit(""))


def js_trim(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def lines_of(content: Column) -> Column:
    """Split on line feeds only; a carriage return stays on its line."""
    return F.split(content, "\n", -1)


def numbered(lines: Column) -> Column:
    """``ARRAY<STRUCT<n INT, t STRING>>`` with 1-based line numbers."""
    return F.transform(lines, lambda t, i: F.struct((i + 1).alias("n"), t.alias("t")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def severity_rank(sev: Column) -> Column:
    return (
        F.when(sev == "critical", F.lit(0)).when(sev == "warning", F.lit(1)).otherwise(F.lit(2))
    )


def words_of(text: Column) -> Column:
    """Distinct ``\\w+`` words of a line, for name lookups without a regex per name."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1)))


def constant_table(rows: list, schema: str) -> Column:
    """A small literal array of structs; folded to a constant at planning time."""
    return F.from_json(F.lit(json.dumps(rows)), schema)
