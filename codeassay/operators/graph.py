"""Dependency graph: edges, ranges, imports, reachability, chains."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import registries as reg
from ..functions.session import cut_lineage
from .files import extension
from .joins import SALTS, hot_keys, key_hash, salted_join


def dep_key(eco: Column, name: Column, version: Column) -> Column:
    return F.concat(eco, F.lit(":"), name, F.lit("@"), version)


def lock_requirements(entries: DataFrame) -> DataFrame:
    """(repo, path, ord, parent_key, child, range): what the entries of lock files ask for.

    ``ord`` orders the entries of a file; a later entry replaces an earlier one
    with the same key.
    """
    return entries.select(
        "repo", "path", "ord", dep_key(F.lit("npm"), F.col("name"), F.col("version")).alias("parent_key"), F.inline("children")
    )


def resolve_edges(requirements: DataFrame, dependencies: DataFrame, scan: str = "repo", order=("source", "ord")) -> DataFrame:
    """Requirements -> edges (scan, parent_key, child_key, range).

    A child resolves to the first npm dependency of that name; children without
    one are dropped; the last entry of a parent that resolves any child wins.
    """
    first = (
        dependencies.filter(F.col("ecosystem") == "npm")
        .groupBy(scan, F.col("name").alias("child"))
        .agg(F.min_by("version", F.struct(*order)).alias("version"))
    )
    edges = salted_join(requirements, first, [scan, "child"]).withColumn(
        "child_key", dep_key(F.lit("npm"), F.col("child"), F.col("version"))
    )
    last = edges.groupBy(scan, "parent_key").agg(F.max(F.struct("path", "ord")).alias("_last"))
    return (
        salted_join(edges, last, [scan, "parent_key"])
        .filter(F.struct("path", "ord") == F.col("_last"))
        .select(scan, "parent_key", "child_key", "range", "path", "ord")
    )


def dep_ranges(dependencies: DataFrame, edges: DataFrame, scan: str = "repo") -> DataFrame:
    """Declared range of a package; otherwise the range its first parent asks for."""
    own = dependencies.filter(F.col("declared_range").isNotNull()).select(
        scan, dep_key(F.col("ecosystem"), F.col("name"), F.col("version")).alias("dep_key"),
        F.struct(F.lit(0).alias("p"), F.lit("").alias("path"), F.array().cast("array<int>").alias("ord"), F.lit("").alias("k"), F.col("declared_range").alias("range")).alias("r"),
    )
    asked = edges.select(
        scan, F.col("child_key").alias("dep_key"),
        F.struct(F.lit(1).alias("p"), "path", "ord", F.col("parent_key").alias("k"), "range").alias("r"),
    )
    return own.unionByName(asked).groupBy(scan, "dep_key").agg(F.min("r").alias("r")).select(scan, "dep_key", F.col("r.range").alias("range"))


# ------------------------------------------------------------------- imports
JS_IMPORT = r"""(?:import\s+(?:[\s\S]*?\s+from\s+)?|import\s*\()['"]([^'"]+)['"]"""
JS_REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
PY_IMPORT = r"(?m)^(?:import\s+(\S+)|from\s+(\S+)\s+import)"


def imports(files: DataFrame) -> DataFrame:
    """Distinct (repo, package) imported by the sources of a repository."""
    ext = F.substring(extension(F.col("path")), 2, 10)
    content = F.col("content")
    js = F.filter(
        F.concat(
            F.regexp_extract_all(content, F.lit(JS_IMPORT), F.lit(1)), F.regexp_extract_all(content, F.lit(JS_REQUIRE), F.lit(1))
        ),
        lambda s: ~s.startswith(".") & ~s.startswith("/"),
    )
    js = F.transform(
        js, lambda s: F.when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1))
    )
    plain = F.regexp_extract_all(content, F.lit(PY_IMPORT), F.lit(1))
    source = F.regexp_extract_all(content, F.lit(PY_IMPORT), F.lit(2))
    py = F.transform(
        F.zip_with(plain, source, lambda a, b: F.when(a != "", a).otherwise(b)), lambda s: F.substring_index(s, ".", 1)
    )
    names = F.when(ext.isin(*reg.IMPORT_EXTENSIONS_JS), js).when(ext == "py", py)
    return files.select("repo", F.explode(F.array_distinct(names)).alias("package")).distinct()


# -------------------------------------------------------------- reachability
def import_seeds(imported: DataFrame, dependencies: DataFrame, scan: str = "repo") -> DataFrame:
    """Keys of the dependencies (any ecosystem) whose name is imported."""
    keys = dependencies.select(
        scan, F.col("name").alias("package"), dep_key(F.col("ecosystem"), F.col("name"), F.col("version")).alias("dep_key")
    ).distinct()
    return keys.join(imported, [scan, "package"], "left_semi").select(scan, "dep_key")


def reachability(edges: DataFrame, seeds: DataFrame, scan: str = "repo", max_rounds: int | None = None) -> DataFrame:
    """All keys reachable from the seeds: (scan, dep_key, depth).

    Breadth-first rounds; each round joins the frontier with the edges and
    drops what is already known.  The edges are partitioned by parent once and
    kept; edges of a hub are spread by a salt.  What is known is kept
    partitioned by key as well, and the levels found since are merged into it
    only when they have grown to half of it, so each key moves a logarithmic
    number of times.  Levels are checkpointed: plans stay short and a lost
    executor costs a partition.
    """
    keys, node = [scan, "parent_key"], [scan, "dep_key"]
    e = edges.select(*keys, "child_key")
    hot = hot_keys(edges, keys)
    is_hot = key_hash(keys).isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("child_key"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    # Rows that are equal lie together by then, so one shuffle serves both.
    e = e.withColumn("_salt", salt).repartition(*keys, "_salt").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    frontier = cut_lineage(seeds.select(*node).distinct().withColumn("depth", F.lit(0)))
    known, size, recent, waiting, depth = frontier.repartition(*node).persist(StorageLevel.MEMORY_AND_DISK), frontier.count(), None, 0, 0
    held = [e, known]
    while max_rounds is None or depth < max_rounds:
        depth += 1
        asked = frontier.select(scan, F.col("dep_key").alias("parent_key")).withColumn("_salt", F.explode(copies))
        new = e.join(asked, [*keys, "_salt"]).select(scan, F.col("child_key").alias("dep_key")).distinct().join(known.select(*node), node, "left_anti")
        if recent is not None:
            new = new.join(recent.select(*node), node, "left_anti")
        frontier = cut_lineage(new.withColumn("depth", F.lit(depth)))
        found = frontier.count()
        if not found:
            break
        recent, waiting = (frontier if recent is None else recent.unionByName(frontier)), waiting + found
        if 2 * waiting >= size:
            merged = cut_lineage(known.unionByName(recent))
            held.pop().unpersist()
            known, size, recent, waiting = merged.repartition(*node).persist(StorageLevel.MEMORY_AND_DISK), size + waiting, None, 0
            held.append(known)
    out = cut_lineage(known if recent is None else known.unionByName(recent))
    for x in held:
        x.unpersist()
    return out


def flag_reachable(findings: DataFrame, reachable: DataFrame, scan: str = "repo", compat: bool = True) -> DataFrame:
    """Add ``reachable`` to dependency findings: true or false when the key can
    be read from the snippet, NULL otherwise.  With ``compat`` the ecosystem
    must be a plain word, so crates.io findings stay NULL."""
    eco = r"\w+" if compat else r"[^\]]+"
    pattern = rf'^\[({eco})\]\s*"([^"]+)":\s*"([^"]+)"$'
    part = lambda g: F.regexp_extract("snippet", pattern, g)
    key = F.when(
        F.col("rule_id").startswith("SCA-") & F.col("snippet").rlike(pattern), dep_key(part(1), part(2), part(3))
    )
    marked = reachable.select(scan, F.col("dep_key").alias("_key"), F.lit(True).alias("_hit")).distinct()
    joined = salted_join(findings.withColumn("_key", key), marked, [scan, "_key"], "left")
    return joined.withColumn(
        "reachable", F.when(F.col("_key").isNotNull(), F.coalesce("_hit", F.lit(False)))
    ).drop("_key", "_hit")


def dep_chains(
    edges: DataFrame, targets: DataFrame, scan: str = "repo", max_depth: int | None = None, max_paths: int | None = None
) -> DataFrame:
    """Upward chains from a target to packages nobody depends on: (scan, target, chain, rank).

    A target has one chain per package nobody depends on (the shortest, then
    the smallest), so cycles end.  ``max_depth`` bounds the nodes of a chain and
    ``max_paths`` the chains of a target (by length, then text); without them
    all are given.

    Chains are built from their ends: packages above the targets are found
    first, then chains grow downwards, a level a round.  A package keeps its
    ``max_paths`` best chains only.  That is exact, as the chains of a package
    through one parent are in the order of the parent's.  So the table has a
    bounded number of rows for each package, not one for each target and
    package above it.  Edges below a hub are spread by a salt.
    """
    node, up_key = [scan, "node"], [scan, "parent"]
    up = cut_lineage(edges.select(scan, F.col("child_key").alias("node"), F.col("parent_key").alias("parent")).distinct())
    wanted = targets.select(scan, "dep_key").distinct()
    upward = up.select(scan, F.col("node").alias("parent_key"), F.col("parent").alias("child_key"))
    above = reachability(upward, wanted, scan, None if max_depth is None else max_depth - 1).select(scan, F.col("dep_key").alias("node"))
    inner = cut_lineage(up.join(above, node, "left_semi"))
    hot = hot_keys(inner, up_key)
    level = cut_lineage(
        above.join(up.select(*node).distinct(), node, "left_anti").select(*node, F.col("node").alias("root"), F.array("node").alias("chain"))
    )
    kept, depth = level, 1
    while depth != max_depth and not level.isEmpty():
        step = salted_join(inner, level.withColumnRenamed("node", "parent"), up_key, hot=hot)
        best = step.groupBy(*node, "root").agg(F.min("chain").alias("chain")).select(*node, "root", F.concat(F.array("node"), "chain").alias("chain"))
        if max_paths is None:
            new = best.join(kept.select(*node, "root"), [*node, "root"], "left_anti")
        else:
            full = kept.groupBy(*node).agg(F.collect_list("root").alias("_roots"))  # at most ``max_paths``
            new = best.join(full, node, "left").filter(F.col("_roots").isNull() | ~F.array_contains("_roots", F.col("root")))
            new = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*node).orderBy("chain")))
            new = new.filter(F.col("_rn") <= max_paths).filter(F.col("_rn") + F.size(F.coalesce("_roots", F.array().cast("array<string>"))) <= max_paths).drop("_roots", "_rn")
        level, depth = cut_lineage(new), depth + 1
        kept = kept.unionByName(level)
    out = kept.join(wanted.withColumnRenamed("dep_key", "node"), node).select(scan, F.col("node").alias("target"), "chain")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(scan, "target").orderBy(F.size("chain"), "chain")))
    return out if max_paths is None else out.filter(F.col("rank") <= max_paths)
