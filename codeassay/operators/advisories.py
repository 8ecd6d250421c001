"""Advisory snapshot: normalisation, severity, join with dependencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.session import cut_lineage, scratch_path
from .joins import copy_hot, most_hashes, salted_join, spread_hot
from .ranking import grouped_index

RAW_SCHEMA = """id STRING, summary STRING, details STRING, aliases ARRAY<STRING>,
severity ARRAY<STRUCT<type:STRING, score:STRING>>,
affected ARRAY<STRUCT<package:STRUCT<name:STRING, ecosystem:STRING>,
  ranges:ARRAY<STRUCT<events:ARRAY<STRUCT<introduced:STRING, fixed:STRING>>>>, versions:ARRAY<STRING>>>,
references ARRAY<STRUCT<type:STRING, url:STRING>>, database_specific STRUCT<severity:STRING>"""


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of advisory documents (JSON lines) with a declared schema."""
    return spark.read.schema(RAW_SCHEMA).json(path)


def parse_advisories(texts: DataFrame, column: str = "value") -> DataFrame:
    return texts.select(F.from_json(column, RAW_SCHEMA).alias("a")).select("a.*")


def severity_of(score: Column, word: Column) -> Column:
    w = F.lower(word)
    return (
        F.when(score >= 7.0, "critical")
        .when(score >= 4.0, "warning")
        .when(score.isNotNull(), "info")
        .when(w.isin("critical", "high"), "critical")
        .when(w.isin("moderate", "medium"), "warning")
        .when(F.coalesce(w, F.lit("")) != "", "info")
        .otherwise("warning")
    )


EVENTS = "array<struct<introduced:string,fixed:string>>"


def affected_ranges(ranges: Column) -> Column:
    """Intervals (introduced, fixed) of a package; an interval without a fix is open. A fix without a start gives none."""

    def of(r: Column) -> Column:
        events = F.filter(F.coalesce(r["events"], F.array().cast(EVENTS)), lambda e: e["introduced"].isNotNull() | e["fixed"].isNotNull())

        def interval(e: Column, i: Column) -> Column:
            later = F.get(F.filter(F.slice(events, i + 1, F.size(events)), lambda x: x["fixed"].isNotNull()), F.lit(0))["fixed"]
            return F.when(e["introduced"].isNotNull(), F.struct(e["introduced"].alias("introduced"), later.alias("fixed")))

        return F.filter(F.transform(events, interval), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.coalesce(ranges, F.array().cast(f"array<struct<events:{EVENTS}>>")), of))


#: Words for stages before and after a release, in order.
STAGES = {"dev": -5, "a": -4, "alpha": -4, "b": -3, "beta": -3, "c": -2, "rc": -2, "pre": -2, "preview": -2, "post": 1, "rev": 1, "r": 1}


#: The most numbers of a plain version, the most digits of each, and its form: most versions are plain.
PLAIN_NUMBERS, PLAIN_DIGITS = 4, 6
PLAIN_VERSION = r"^(0|[1-9][0-9]{0,%d})(\.(0|[1-9][0-9]{0,%d})){0,%d}$" % (PLAIN_DIGITS - 1, PLAIN_DIGITS - 1, PLAIN_NUMBERS - 1)


def _short_number(digits: Column) -> Column:
    return F.lpad(digits, PLAIN_DIGITS, "#")


def _number(digits: Column) -> Column:
    """A number without leading zeros as a text in its order: filled up from the left, or, if it is long, after a letter for its length."""
    long = F.concat(F.char(F.length(digits) + 64), digits)
    return F.when(digits.isNull(), _short_number(F.lit(""))).when(F.length(digits) <= PLAIN_DIGITS, _short_number(digits)).otherwise(long)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, and outside of the compiled code of the row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def version_key(version: Column, ecosystem: Column) -> Column:
    """Versions of an ecosystem in their order, as a text that Spark compares: numbers, then what stands before or after the release.

    PyPI orders by stages (dev, a, b, rc, release, post), the others by semantic
    versions: a pre-release comes before its release, numeric parts before
    words.  Build data does not count; trailing zeros do not either.  A text
    without a leading number is null.

    A list ends in ``!``, which comes before the beginning of every part, and a
    word in a zero byte, so texts compare as the lists of numbers and words do.
    All have four numbers at least.  Plain versions are tried first; the rest
    stays out of the compiled code, which would be too long to run fast.
    """
    release = F.concat(F.lit("F"), _short_number(F.lit("0")), F.lit("\0"))
    text = lambda numbers, tail: F.concat(numbers, F.lit("!"), tail, F.lit("!"))
    part = lambda rank, n, word: _once(n.cast("string"), lambda n: F.concat(F.char(rank + 70), _number(n), word, F.lit("\0")))

    def other(plain: Column, core: Column) -> Column:
        whole = lambda x: x.cast("decimal(30,0)")
        digits = F.transform(F.split(F.regexp_replace(core, r"(?:\.0+)+$", ""), r"\."), lambda x: whole(x).cast("string"))
        numbers = _once(digits, lambda x: F.concat(F.array_join(F.transform(x, _number), ""), F.repeat(_short_number(F.lit("0")), PLAIN_NUMBERS - F.size(x))))
        rest = F.substr(plain, F.length(core) + 1)
        number = lambda x: F.coalesce(whole(F.nullif(x, F.lit(""))), whole(F.lit(0)))
        ranks = F.create_map(*[F.lit(x) for p in STAGES.items() for x in p])
        staged = F.transform(
            F.regexp_extract_all(F.lower(rest), F.lit(r"([a-z]+[._-]?\d*)"), F.lit(1)),
            lambda x: part(F.coalesce(ranks[F.regexp_extract(x, "^([a-z]+)", 1)], F.lit(-1)), number(F.regexp_extract(x, r"(\d*)$", 1)), F.lit("")),
        )
        shown = lambda x: F.replace(F.replace(x, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1"))
        words = F.transform(
            F.filter(F.split(F.regexp_replace(rest, "^-", ""), r"\."), lambda x: x != ""),
            lambda x: F.when(x.rlike(r"^\d+$"), part(F.lit(-2), number(F.regexp_extract(x, r"^(\d*)", 1)), F.lit(""))).otherwise(part(F.lit(-1), F.lit(0), shown(x))),
        )
        before = _once(F.array_join(words, ""), lambda x: F.when(x == "", release).otherwise(x))
        tail = F.when(ecosystem == "PyPI", F.concat(F.array_join(staged, ""), release)).otherwise(before)
        return F.when(core != "", text(numbers, tail))

    def any_form(version: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.trim(version), r"^[vV=]+", ""), r"\+.*$", "")
        return _once(plain, lambda p: _once(F.regexp_extract(p, r"^(\d+(?:\.\d+)*)", 1), lambda c: other(p, c)))

    pieces = F.split(version, r"\.")
    few = F.concat(*[_short_number(F.coalesce(F.get(pieces, F.lit(i)), F.lit("0"))) for i in range(PLAIN_NUMBERS)])
    simple = F.concat(F.when(version.rlike(PLAIN_VERSION), ""), text(few, release))  # null if the version is not plain
    return F.coalesce(simple, _once(version, any_form))


#: Packages with more pairs of a version and an interval than this go through the interval index, unless they have few intervals.
DIRECT_PAIRS, FEW_SPANS = 4096, 16
#: Blocks of the interval index that make a block of the next level, as a power of two.
FAN_BITS = 4
#: Versions that travel as one row through the index, at most; packages that are sent to all tasks as a table, at most.
TOGETHER, SENT_PACKAGES = 1024, 200_000
#: From so many versions on, those of a package are dealt over several tasks.
HOT_VERSIONS = 1_000_000


def range_hits(used: DataFrame, advisories: DataFrame, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """(ecosystem, name, version, adv): used versions inside an affected interval.

    ``used`` has distinct packages and versions, so a package that everybody
    depends on is a few rows.  A version meets the intervals of its package as
    one row, compares, and gives each advisory once; packages with many pairs
    go through ``indexed_hits``.  Both give the same rows.  Versions are counted
    only for packages with more than a few intervals.
    """
    package = ["ecosystem", "name"]
    a = advisories.select("*", F.explode("packages").alias("_p")).select("*", F.explode("_p.ranges").alias("_r"))
    spans = a.select(
        F.col("_p.ecosystem").alias("ecosystem"), F.col("_p.name").alias("name"),
        F.when(F.col("_r.introduced") != "0", version_key(F.col("_r.introduced"), F.col("_p.ecosystem"))).alias("_low"),
        (F.col("_r.introduced") == "0").alias("_all"), version_key(F.col("_r.fixed"), F.col("_p.ecosystem")).alias("_fix"),
        F.col("_r.fixed").isNull().alias("_open"), F.struct("id", "summary", "severity", "aliases", "fixed_version").alias("adv"),
    )
    # What is read several times is made once, and tested afterwards: a test before would make the keys twice.
    spans = _stored(spans, "spans").filter((F.col("_all") | F.col("_low").isNotNull()) & (F.col("_open") | F.col("_fix").isNotNull()))
    key = version_key(F.col("version"), F.col("ecosystem")).alias("_key")
    crowded, large = _few(cut_lineage(spans.groupBy(*package).agg(F.count("*").alias("_i")).filter(F.col("_i") > min(direct_pairs, FEW_SPANS)))), None
    if crowded:
        used = _stored(used.select(*package, "version"), "used")
        counted = used.groupBy(*package).agg(F.count("*").alias("_v")).join(crowded, package)
        sizes = cut_lineage(counted.filter(F.col("_v") * F.col("_i") > direct_pairs).select(*package, "_v"))
        large = _few(sizes.select(*package))
    other = spans.join(large, package, "left_anti") if large else spans
    if large:
        hot = most_hashes(sizes.select(*package, F.col("_v").alias("n")), package, HOT_VERSIONS)
        many = indexed_hits(used.join(large, package, "left_semi").select("*", key), spans.join(large, package, "left_semi"), hot)
        if other.isEmpty():
            return many
    listed = other.groupBy(*package).agg(F.collect_list(F.struct("_low", "_all", "_fix", "_open", "adv")).alias("_spans"))
    met = used.join(listed, package).select(*package, "version", "_spans", key)
    inside = lambda s: F.col("_key").isNotNull() & (s["_all"] | (F.col("_key") >= s["_low"])) & (s["_open"] | (F.col("_key") < s["_fix"]))
    few = met.select(*package, "version", F.explode(F.array_distinct(F.transform(F.filter("_spans", inside), lambda s: s["adv"]))).alias("adv"))
    return few.unionByName(many) if large else few


def _few(packages: DataFrame) -> DataFrame | None:
    """A table of packages that joins without moving the other side if it is small; nothing if it is empty."""
    n = packages.count()
    return (F.broadcast(packages) if n <= SENT_PACKAGES else packages) if n else None


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def indexed_hits(keyed: DataFrame, spans: DataFrame, hot: list[int]) -> DataFrame:
    """The same for packages with many versions and many intervals, at the cost of their sum and the hits.

    The bounds of a package cut its versions into segments, numbered in version
    order; the intervals of an advisory are made disjoint.  Versions are sorted
    among the bounds once, and those of a segment go on together.  Sixteen
    blocks make one of the next level.  An interval of segments falls into a
    bounded number of blocks a level, a segment lies in one block of each level;
    they meet in exactly one block if the segment is inside, so the join is by
    block, tests nothing more and gives each row once.  Versions of the packages
    in ``hot`` (hashes) are dealt over several copies of their bounds.
    """
    package, hashed = ["name", "ecosystem"], ["ecosystem", "name"]
    ends = spans.select(F.struct(*package).alias("_pkg"), F.explode(F.array("_low", "_fix")).alias("_key")).filter("_key is not null").distinct()
    placed = _stored(grouped_index(ends, "_pkg", ["_key"], "_at").select("_pkg.*", "_key", (F.col("_at") + 1).alias("_bound")), "bounds")

    # A version lies in the segment of the last bound that is not after it, 0 before all bounds.
    points = spread_hot(keyed.select(*package, "version", "_key", F.lit(None).cast("bigint").alias("_bound")), hashed, hot)
    marks = copy_hot(placed.select(*package, F.lit(None).cast("string").alias("version"), "_key", "_bound"), hashed, hot)
    in_order = Window.partitionBy(*package, "_salt").orderBy("_key", F.asc_nulls_last("_bound"))
    so_far, all_of = (in_order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    sorted_in = points.unionByName(marks).select(
        *package, "_salt", "version", "_key", "_bound", F.coalesce(F.max("_bound").over(so_far), F.lit(0)).alias("_segment"),
        F.coalesce(F.max("_bound").over(all_of), F.lit(0)).alias("_last"), F.floor(F.row_number().over(in_order) / TOGETHER).alias("_some"),
    )
    segments = sorted_in.filter("_bound is null and _key is not null").groupBy(*package, "_salt", "_last", "_segment", "_some").agg(F.collect_list("version").alias("_versions"))

    top = F.floor((F.length(F.bin(F.col("_last") + 1)) - 1) / FAN_BITS).cast("int")
    levels = F.sequence(F.lit(0), F.col("_top"))
    block = lambda k: F.struct(k.alias("_level"), F.call_function("shiftright", F.col("_segment"), k * FAN_BITS).alias("_block"))
    blocks = segments.withColumn("_top", top).select(*package, "_salt", "_versions", F.inline(F.transform(levels, block)))

    bound = lambda name, at: placed.select(*package, F.col("_key").alias(name), F.col("_bound").alias(at))
    size = placed.groupBy(*package).agg(F.max("_bound").alias("_last"))
    ranged = spans.join(bound("_low", "_from"), [*package, "_low"], "left").join(bound("_fix", "_until"), [*package, "_fix"], "left").join(size, package, "left")
    ranged = ranged.withColumn("_last", F.coalesce("_last", F.lit(0)))
    low, high = F.coalesce("_from", F.lit(0)).cast("bigint"), F.coalesce("_until", F.col("_last") + 1).cast("bigint")
    # Two intervals of an advisory that overlap share no segment afterwards.
    earlier = Window.partitionBy(*package, "adv").orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.select(*package, "adv", top.alias("_top"), low.alias("_lo"), high.alias("_hi")).withColumn("_done", F.max("_hi").over(earlier))
    ranged = ranged.withColumn("_lo", F.greatest("_lo", "_done")).filter("_lo < _hi")

    def level(k):
        step = F.call_function("shiftleft", F.lit(1).cast("bigint"), k * FAN_BITS)
        first, last = F.ceil(F.col("_lo") / step).cast("bigint"), F.floor(F.col("_hi") / step).cast("bigint")  # whole blocks inside: first to last - 1
        fan = 1 << FAN_BITS
        up, down = F.ceil(first / fan).cast("bigint") * fan, F.floor(last / fan).cast("bigint") * fan
        top = (k == F.col("_top")) | (up >= down)  # nothing of a higher level between them
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        these = F.when(top, run(first, last)).otherwise(F.concat(run(first, up), run(down, last)))
        return F.transform(these, lambda b: F.struct(k.alias("_level"), b.alias("_block")))

    cover = copy_hot(ranged.select(*package, "adv", F.inline(F.flatten(F.transform(levels, level)))), hashed, hot)
    met = blocks.join(cover, [*package, "_salt", "_level", "_block"])
    return met.select("ecosystem", "name", F.explode("_versions").alias("version"), "adv")


def normalise_advisories(raw: DataFrame) -> DataFrame:
    """Raw documents -> id, summary, details, severity, aliases, cvss_score,
    fixed_version, references, packages (name, ecosystem, versions, ranges)."""
    v3 = F.get(F.filter("severity", lambda s: s["type"] == "CVSS_V3"), F.lit(0))["score"]
    number = F.regexp_extract(v3, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    score = F.nullif(number, F.lit("")).try_cast("double")
    fixes = F.flatten(
        F.transform(
            F.coalesce("affected", F.array().cast("array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>,versions:array<string>>>")),
            lambda a: F.flatten(
                F.transform(
                    F.coalesce(a["ranges"], F.array().cast("array<struct<events:array<struct<introduced:string,fixed:string>>>>")),
                    lambda r: F.transform(
                        F.filter(
                            F.coalesce(r["events"], F.array().cast("array<struct<introduced:string,fixed:string>>")),
                            lambda e: F.coalesce(e["fixed"], F.lit("")) != "",
                        ),
                        lambda e: e["fixed"],
                    ),
                )
            ),
        )
    )
    return raw.select(
        "id",
        F.coalesce("summary", F.lit("No summary available")).alias("summary"),
        F.coalesce("details", F.lit("")).alias("details"),
        severity_of(score, F.col("database_specific.severity")).alias("severity"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        score.alias("cvss_score"),
        F.get(fixes, F.lit(0)).alias("fixed_version"),
        F.coalesce(F.transform("references", lambda r: r["url"]), F.array().cast("array<string>")).alias("references"),
        F.transform(
            "affected",
            lambda a: F.struct(
                a["package"]["name"].alias("name"), a["package"]["ecosystem"].alias("ecosystem"), a["versions"].alias("versions"),
                affected_ranges(a["ranges"]).alias("ranges"),
            ),
        ).alias("packages"),
    )


def affected_versions(advisories: DataFrame) -> DataFrame:
    """One row per (ecosystem, name, version) and advisory."""
    a = advisories.select("*", F.explode("packages").alias("_p")).select("*", F.explode("_p.versions").alias("version"))
    return a.select(
        F.col("_p.ecosystem").alias("ecosystem"), F.col("_p.name").alias("name"), "version",
        F.struct("id", "summary", "severity", "aliases", "fixed_version").alias("adv"),
    ).distinct()


def upgrade_command(name: Column, version: Column, ecosystem: Column, dev: Column) -> Column:
    return (
        F.when(ecosystem == "npm", F.concat(F.lit("Run: npm install "), name, F.lit("@"), version, F.when(dev, " --save-dev").otherwise("")))
        .when(ecosystem == "PyPI", F.concat(F.lit("Run: pip install "), name, F.lit("=="), version))
        .when(ecosystem == "Go", F.concat(F.lit("Run: go get "), name, F.lit("@"), version))
        .when(ecosystem == "crates.io", F.concat(F.lit("Update Cargo.toml: "), name, F.lit(' = "'), version, F.lit('"')))
    )


def dev_label(dev: Column) -> Column:
    return F.when(dev, F.lit(" (dev)")).otherwise(F.lit(""))


def scan_sca(dependencies: DataFrame, advisories: DataFrame, scan: str = "repo", failed: DataFrame | None = None) -> DataFrame:
    """Findings for every occurrence of an affected package version; scans in ``failed`` (their look-up broke off) have none.

    Advisories are cut down to the packages in use, which are found once,
    before the join, and the occurrences are salted: a package that everybody
    uses does not end in one task.  Failed scans go afterwards, so that only
    occurrences with findings are moved for them.
    """
    used = cut_lineage(dependencies.select("ecosystem", "name", "version").distinct())
    listed = affected_versions(advisories).join(used, ["ecosystem", "name", "version"], "left_semi")
    hits = listed.unionByName(range_hits(used, advisories)).distinct()
    rows = salted_join(dependencies, hits, ["ecosystem", "name", "version"])
    if failed is not None:
        rows = rows.join(failed.select(scan).distinct(), scan, "left_anti")
    name, version, eco, dev, adv = (F.col(c) for c in ("name", "version", "ecosystem", "dev", "adv"))
    cve = F.coalesce(F.get(F.filter(adv["aliases"], lambda a: a.startswith("CVE-")), F.lit(0)), adv["id"])
    fix = F.when(
        adv["fixed_version"].isNotNull(),
        F.concat(
            F.lit(" Safe version: "), adv["fixed_version"], F.lit(". "),
            F.coalesce(upgrade_command(name, adv["fixed_version"], eco, dev), F.lit("")),
        ),
    ).otherwise(F.lit(" Check the advisory for remediation steps."))
    return rows.select(
        scan,
        F.concat(F.lit("SCA-"), adv["id"]).alias("rule_id"),
        F.concat(F.lit("Vulnerable dependency: "), name, dev_label(dev)).alias("rule_name"),
        adv["severity"].alias("severity"),
        F.lit("high").alias("confidence"),
        F.concat(
            name, F.lit("@"), version, dev_label(dev), F.lit(" has a known vulnerability: "), adv["summary"],
            F.lit(" ("), cve, F.lit(")"),
        ).alias("message"),
        F.col("source").alias("file_path"),
        "line",
        F.lit(1).alias("column"),
        F.concat(F.lit("["), eco, F.lit('] "'), name, F.lit('": "'), version, F.lit('"')).alias("snippet"),
        F.lit("CWE-1395").alias("cwe"),
        F.lit("A06:2021").alias("owasp"),
        F.concat(F.lit("Upgrade "), name, F.lit(" to a non-vulnerable version."), fix).alias("suggestion"),
        F.concat(eco, F.lit(":"), name, F.lit("@"), version).alias("dep_key"),
    )


def sca_metrics(unique_dependencies: DataFrame, advisories: DataFrame | None, scan: str = "repo", failed: DataFrame | None = None) -> DataFrame:
    """Package count per scan and whether the advisory check had to be skipped.

    It is skipped for all scans where there are no advisories (an empty table
    has none to give), and for the scans in ``failed``: those whose look-up
    broke off.
    """
    counts = unique_dependencies.groupBy(scan).agg(F.count("*").alias("dep_count"))
    if advisories is None:
        return counts.withColumn("skipped", F.lit(True))
    listed = advisories.limit(1).agg(F.count("*").alias("n")).scalar()  # a subquery of the plan, no action here
    out = counts.withColumn("skipped", listed == 0)
    if failed is None:
        return out
    broken = failed.select(scan).distinct().withColumn("_broken", F.lit(True))
    return out.join(broken, scan, "left").withColumn("skipped", F.col("skipped") | F.coalesce("_broken", F.lit(False))).drop("_broken")
