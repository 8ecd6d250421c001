"""Corpus selection: languages, ignore rules, tree filter, changed files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..catalog import registries as reg
from ..functions.text import base_name
from ..sources import tree
from .files import extension, language_of


def read_corpus(
    spark: SparkSession, root: str, *, repo: str | None = None, ignore=reg.DEFAULT_IGNORE, languages=None,
    max_bytes: int | None = None, manifests: bool = True, repo_depth: int = 1,
) -> DataFrame:
    """Source files and manifests below a folder, as (repo, path, content, size); paths count from the folder.

    A repository is named by the first ``repo_depth`` segments below ``root``
    (files directly in it by the folder itself), or by ``repo``.  Paths are
    taken as they are: any character may stand in them.  Folders that are
    ignored are not listed, and only contents of files that are left are read.
    ``max_bytes`` does not hold for manifests.
    """
    exts = [e for e, lang in reg.EXTENSION_LANGUAGE.items() if not languages or lang in languages]
    listed = tree.list_tree(spark, root, ignore)
    wanted = extension(F.col("path")).isin(exts)
    if max_bytes is not None:
        wanted = wanted & (F.col("size") <= max_bytes)
    if manifests:
        wanted = wanted | is_manifest(F.col("path"))
    parts = F.split("path", "/")
    top = F.lit(tree.without_scheme(root).rstrip("/").rsplit("/", 1)[-1])
    named = F.when(F.size(parts) > repo_depth, F.array_join(F.slice(parts, 1, repo_depth), "/")).otherwise(top)
    return tree.read_files(listed.filter(wanted), root).select((F.lit(repo) if repo is not None else named).alias("repo"), "path", "content", "size")


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file; blank lines and comments are dropped."""
    lines = [line.strip() for line in text.split("\n")]
    return [*reg.DEFAULT_IGNORE, *[x for x in lines if x and not x.startswith("#")]]


def is_ignored(path: Column, patterns) -> Column:
    """A pattern matches as a whole segment or as ``*.x`` suffix.  A pattern
    that ends in a slash never matches; that is kept."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    tests = []
    for x in patterns:
        tests += [p.contains(f"/{x}/"), p.endswith(f"/{x}")]
        if x.startswith("*."):
            tests.append(p.endswith(x[1:]))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def detect_language(files: DataFrame) -> DataFrame:
    """Add the language; files of unknown extensions are dropped."""
    return files.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull())


def guess_language(content: Column) -> Column:
    """Language of a text without a file name."""
    t = F.regexp_replace(content, r"^\s+", "")
    plain_import = t.startswith("import ") & ~t.rlike("^import [{'\"]")
    return (
        F.when(
            plain_import
            | t.startswith("from ")
            | t.rlike(r"(?<!\w)def\s+\w+\s*\(")
            | t.rlike(r"(?<!\w)class\s+\w+.*:")
            | t.contains("print("),
            "python",
        )
        .when(content.rlike(r":\s*(?:string|number|boolean|void)(?!\w)") | content.rlike(r"interface\s+\w+"), "typescript")
        .otherwise("javascript")
    )


def is_manifest(path: Column) -> Column:
    return base_name(path).isin(list(reg.MANIFEST_NAMES))


def scannable(path: Column) -> Column:
    """Manifest, or one of the hosted extensions."""
    return is_manifest(path) | extension(path).isin(list(reg.HOSTED_EXTENSIONS))


def tree_filter(tree: DataFrame, *, max_bytes: int | None = None, cap: int | None = None, order: str = "path") -> DataFrame:
    """Entries (repo, path, type, size) worth fetching; no limit unless one is asked for.

    ``max_bytes`` does not hold for manifests.  ``cap`` keeps the first N per
    repository in tree order; the ranking is pre-limited before the shuffle, so
    a huge repository stays cheap.
    """
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in reg.TREE_SKIP_SEGMENTS]))
    kept = tree.filter((F.col("type") == "blob") & ~skipped & scannable(F.col("path")))
    if max_bytes is not None:
        kept = kept.filter(is_manifest(F.col("path")) | (F.coalesce("size", F.lit(0)) <= max_bytes))
    if cap is None:
        return kept
    w = Window.partitionBy("repo").orderBy(order)
    return kept.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def changed_in_pull_request(files: DataFrame) -> DataFrame:
    """(repo, path, status) of pull requests -> the ones to scan."""
    return files.filter((F.col("status") != "removed") & scannable(F.col("path")))


def changed_in_work_tree(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame) -> DataFrame:
    """Distinct (repo, path) of the three change lists, without blank names."""
    names = staged.select("repo", "path").union(unstaged.select("repo", "path")).union(untracked.select("repo", "path"))
    return names.select("repo", F.trim("path").alias("path")).filter(F.col("path") != "").distinct()


def restrict_to(corpus: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of the corpus that changed: the same path in the same repository."""
    return corpus.join(changed.select("repo", "path"), ["repo", "path"], "left_semi")


def repo_of_url(url: Column) -> Column:
    """owner and repository of a hosting address, NULL when it is none."""
    pattern = r"github\.com/([^/]+)/([^/\s#?]+)"
    return F.when(
        url.rlike(pattern),
        F.struct(
            F.regexp_extract(url, pattern, 1).alias("owner"),
            F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "").alias("repo"),
        ),
    )


def within_snippet_limit(snippets: DataFrame, most: int | None = None) -> DataFrame:
    """Pasted code beyond a service's limit (SNIPPET_CHAR_CAP, say) is rejected, not cut; without one all of it stays."""
    return snippets if most is None else snippets.filter(F.length("content") <= most)
