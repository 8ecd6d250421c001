"""Line views of files: numbered lines, context windows, quick triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import detectors as cat
from ..functions.text import lines_of, numbered, rx
from .files import js_sanitized, sql_template_lines


def explode_lines(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, text)."""
    return files.select("repo", "path", F.posexplode(lines_of(F.col("content"))).alias("_p", "text")).select(
        "repo", "path", (F.col("_p") + 1).alias("line_no"), "text"
    )


def with_context(files: DataFrame, before: int, after: int, where=None) -> DataFrame:
    """Lines with ``context``: the lines from ``before`` above to ``after`` below.

    ``where`` (text column -> condition) keeps only the lines of interest, so
    neighbours are copied for those alone.  No shuffle.
    """
    base = files.select("repo", "path", lines_of(F.col("content")).alias("_l"))
    lines = F.col("_l")

    def pick(t: Column, i: Column) -> Column:
        first = F.greatest(i + 1 - before, F.lit(1))
        item = F.struct(
            (i + 1).alias("line_no"), t.alias("text"), F.slice(lines, first, i + 1 - first + F.lit(after + 1)).alias("context")
        )
        return F.when(where(t), item) if where is not None else item

    picked = F.filter(F.transform(lines, pick), lambda x: x.isNotNull() & (F.size(lines) > 0))
    return base.select("repo", "path", F.explode(picked).alias("c")).select("repo", "path", "c.line_no", "c.text", "c.context")


def excerpt(lines: Column, line: Column) -> Column:
    """Numbered excerpt around a line: five lines above, the line, five below."""
    first = F.greatest(line - 5, F.lit(1))
    part = F.slice(lines, first, line + 5 - first + 1)
    return F.array_join(
        F.transform(part, lambda t, i: F.concat((first + i).cast("string"), F.lit(": "), t)), "\n"
    )


def multiline_sql_templates(files: DataFrame) -> DataFrame:
    """Start lines of SQL template literals that span lines (JavaScript files)."""
    content = F.col("content")
    found = sql_template_lines(content, js_sanitized(content, "sql"))
    return (
        files.filter(F.col("language") != "python")
        .select("repo", "path", F.explode(found).alias("line"))
    )


def quick_scan(files: DataFrame) -> DataFrame:
    """Coarse first pass: six line patterns plus one pattern over the whole text."""
    content = F.col("content")
    table = numbered(lines_of(content))

    def hits(x: Column) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(rx(x["t"], p), F.struct(x["n"].alias("line"), F.lit(i).alias("rule")))
                    for i, (_, _, _, p) in enumerate(cat.QUICK)
                ]
            )
        )

    pattern = cat.QUICK_TEMPLATE
    pieces = F.split(content, pattern, -1)
    matches = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    newlines = lambda s: F.size(F.split(s, "\n", -1)) - 1
    starts = F.aggregate(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), matches.alias("m")),
        F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("out")),
        lambda acc, z: F.struct(
            (acc["line"] + newlines(z["p"]) + newlines(z["m"])).alias("line"),
            F.array_append(acc["out"], acc["line"] + newlines(z["p"])).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    gate = content.contains("query") & content.contains("${") & content.contains("`")
    prepared = files.select(
        "repo",
        "path",
        F.flatten(F.transform(table, hits)).alias("_h"),
        F.when(gate, starts).otherwise(F.array().cast("array<int>")).alias("_s"),
    )
    sql_lines = F.transform(F.filter("_h", lambda h: h["rule"] == 0), lambda h: h["line"])
    extra = F.transform(
        F.array_distinct(F.array_except("_s", sql_lines)), lambda n: F.struct(n.alias("line"), F.lit(len(cat.QUICK)).alias("rule"))
    )
    rules = [*cat.QUICK, ("SQL injection", "critical", "CWE-89", "")]
    names = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(c).alias("cwe")) for n, s, c, _ in rules]
    )
    return (
        prepared.select("repo", "path", F.explode(F.concat("_h", extra)).alias("h"))
        .withColumn("r", F.element_at(names, F.col("h.rule") + 1))
        .select("repo", "path", F.col("h.line").alias("line"), "r.rule", "r.severity", "r.cwe")
    )
