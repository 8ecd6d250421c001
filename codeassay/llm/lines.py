"""Line dedup within an edit bound, by a join of deletion neighbourhoods; DataFrame functions only.

Two lines differ by at most one edit exactly if they are equal, or a deletion at
one place makes them equal (a replaced character), or a deletion makes one the
other (an inserted one).  So every variant of a line with one character deleted
is a key: together with its place it finds replacements, by itself it finds
insertions.  Lines that share a key of the first kind all lie within the bound
of each other, and those of the second kind within that of the shorter line, so
each key only has to name its earliest line; no pairs are formed.

A line of n characters has n variants.  Only lines that can have a partner make
them, and only where the edit can be.  One edit leaves the first or the last half
of the shorter line as it is, so partners share the hash of a half for one
length; those hashes are counted first.  Lines with a shared half are then cut
into more blocks: partners share all but one, and only that block's deletions
are emitted, keyed by all that surrounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.session import cut_lineage
from .keys import classes, value_class

#: Blocks that lines with a shared half are cut into.
BLOCKS = 16
WORD = r"[^\x20\x09-\x0D]"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, n, line): all lines of all texts, cut at line feeds. ``t`` is the text's hash, ``n`` counts from 0."""
    named = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("lines"))
    return named.select("k", "t", F.posexplode("lines").alias("n", "line"))


def with_hashes(lines: DataFrame) -> DataFrame:
    """Lines that hold a word, with 96 bits of hashes (h, g) and their length (m)."""
    return lines.filter(F.col("line").rlike(WORD)).withColumns({"h": F.xxhash64("line"), "g": F.hash("line", F.lit(1)), "m": F.char_length("line")})


def half_keys(line: str, m: str) -> Column:
    """Keys of the halves that an edit can leave: for pairs in which the line is the shorter one or of equal length, and the longer one."""
    parts = []
    for short in (m, f"({m} - 1)"):
        half = f"({short} div 2)"
        parts.append(f"xxhash64('first', {short}, left({line}, cast({half} as int)))")
        parts.append(f"xxhash64('last', {short}, right({line}, cast({short} - {half} as int)))")
    return F.expr(f"array({', '.join(parts)})")


def candidate_lines(hashed: DataFrame, least_chars: int) -> DataFrame:
    """(h, g, m, line): distinct lines that share half with another line of a length in reach."""
    long = hashed.filter(F.col("m") >= least_chars)
    keys = long.select("h", "g", "m", "line", F.explode(half_keys("line", "m")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("key")
    shared = cut_lineage(shared)
    # A filter of bounded size before the exact join: few of the other lines' texts are shuffled.
    some = keys.withColumn("_class", value_class("key")).join(classes(shared, "key"), "_class", "left_semi").groupBy("key", "h", "g", "m").agg(F.min("line").alias("line"))
    return some.join(shared, "key", "left_semi").groupBy("h", "g", "m").agg(F.min("line").alias("line"))


def shared_blocks(lines: DataFrame) -> DataFrame:
    """(h, g, m, first, around, short, middle): where a line may differ from another that has all around the block in common.

    ``short`` is the length of the shorter line of the pair, ``around`` the hash
    of it, of the block's number and of what stands before and behind.
    """
    parts = []
    for short in ("m", "(m - 1)"):
        before, behind = f"cast({short} * b div {BLOCKS} as int)", f"cast({short} - {short} * (b + 1) div {BLOCKS} as int)"
        around = f"xxhash64({short}, b, left(line, {before}), right(line, {behind}))"
        parts.append(f"transform(sequence(0, {BLOCKS} - 1), b -> struct({around} AS around, {short} AS short, {before} AS before, {behind} AS behind))")
    keys = lines.select("h", "g", "m", "first", "line", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select("h", "g", "m", "first", "line", "x.*")
    shared = keys.groupBy("around").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("around")
    middle = F.expr("substr(line, before + 1, m - before - behind)")
    return keys.join(shared, "around", "left_semi").select("h", "g", "m", "first", "around", "short", middle.alias("middle"))


def variant_keys(blocks: DataFrame) -> DataFrame:
    """(key, whole, h, g, first): the hashed variants of each block, and the block itself as what a longer one may become.

    ``whole`` is 1 for the block itself, 0 for what it becomes by a deletion,
    null for a variant with its place.
    """
    places = "if(length(middle) = 0, array(), sequence(1, length(middle)))"
    without = "concat(left(middle, i - 1), substr(middle, i + 1))"
    replaced = f"transform({places}, i -> struct(xxhash64('replaced', around, i, {without}) AS key, cast(null AS int) AS whole))"
    inserted = f"transform({places}, i -> struct(xxhash64('inserted', around, {without}) AS key, 0 AS whole))"
    itself = "array(struct(xxhash64('inserted', around, middle) AS key, 1 AS whole))"
    kinds = F.expr(f"if(m = short, concat({replaced}, {itself}), {inserted})")
    return blocks.select("h", "g", "first", F.explode(kinds).alias("x")).select("x.*", "h", "g", "first")


def earlier_neighbours(lines: DataFrame, bound: int) -> DataFrame:
    """(h, g): lines that an earlier line in the corpus matches within the edit bound. ``lines``: h, g, m, first, line."""
    keys = variant_keys(cut_lineage(shared_blocks(lines)))
    seen = F.struct("first", "h", "g")
    best = keys.groupBy("key").agg(
        F.min(F.when(F.coalesce("whole", F.lit(1)) == 1, seen)).alias("one"), F.min(F.when(F.col("whole") == 0, seen)).alias("other"), F.count("*").alias("n")
    )
    found = keys.join(best.filter("n > 1"), "key").withColumn("match", F.when(F.col("whole") == 1, F.col("other")).otherwise(F.col("one")))
    found = found.filter("match.first < first").groupBy("h", "g").agg(F.min("match").alias("match"))
    mine = lines.select("h", "g", "line").join(found, ["h", "g"])
    theirs = lines.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("line").alias("line2"))
    checked = mine.join(theirs, (F.col("match.h") == F.col("h2")) & (F.col("match.g") == F.col("g2")))
    return checked.filter(F.levenshtein("line", "line2", bound) >= 0).select("h", "g")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 16) -> DataFrame:
    """The columns of ``docs`` with repeated lines taken out of ``text``; ``n_lines``, ``n_equal`` and ``n_near`` count.

    Lines are cut at line feeds.  Of equal lines that hold a word the earliest
    stays; a line of ``least_chars`` characters or more also goes, wherever it
    stands, if a line before its first place, also of that length, matches it by
    at most one inserted, deleted or replaced character, whether that one stays
    or not.  Earlier is by key (null first), then the
    hash of the text, then place.  Lines without a word stay.  Rows that repeat
    key and text are one text and keep the same lines.  Null texts stay null,
    with no lines; a text whose lines all go becomes empty.  Columns of
    ``docs`` named like the counts give way.  An empty table gives an empty result.
    """
    lines = lines_of(docs, key, text)
    hashed = with_hashes(lines)
    place = F.struct("k", "t", "n")
    firsts = cut_lineage(hashed.groupBy("h", "g").agg(F.min(place).alias("first")))
    near = candidate_lines(hashed, least_chars).join(firsts, ["h", "g"])
    near = cut_lineage(earlier_neighbours(cut_lineage(near), bound=1))
    known = firsts.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left")
    fate = hashed.select("k", "t", "n", "h", "g").join(known, ["h", "g"]).select(
        "k", "t", "n", F.when(F.col("near"), F.lit(2)).when(~place.eqNullSafe(F.col("first")), F.lit(1)).otherwise(F.lit(0)).cast("byte").alias("fate")
    )
    blank = lines.filter(~F.col("line").rlike(WORD)).select("k", "t", "n", F.lit(0).cast("byte").alias("fate"))
    each = fate.union(blank).groupBy("k", "t").agg(F.array_sort(F.collect_set(F.struct("n", "fate"))).alias("all"), F.max("fate").alias("worst"))
    each = each.filter("worst > 0").select("k", "t", F.transform("all", lambda x: x["fate"]).alias("fates"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_equal", "n_near")]
    texts = docs.select(*[F.col(c).alias(f"_{c}") for c in kept], F.xxhash64(text).alias("t_hash"))
    joined = texts.join(each, F.col(f"_{key}").eqNullSafe(F.col("k")) & (F.col("t_hash") == F.col("t")), "left")
    cut = F.split(f"_{text}", "\n", -1)
    left = F.array_join(F.filter(cut, lambda _, i: F.get("fates", i) == 0), "\n")
    new = F.when(F.col("fates").isNull(), F.col(f"_{text}")).otherwise(left)
    count = lambda kind: F.coalesce(F.size(F.filter("fates", lambda x: x == kind)), F.lit(0)).cast("bigint")
    # Size of a null array is null here, also where the session has the older rule of -1.
    n_lines = F.when(F.col(f"_{text}").isNull(), F.lit(0)).otherwise(F.size(cut)).cast("bigint")
    hits = {name: F.when(F.col("fates").isNull(), F.lit(0)).otherwise(count(kind)) for name, kind in (("n_equal", 1), ("n_near", 2))}
    return joined.select(*[(new if c == text else F.col(f"_{c}")).alias(c) for c in kept], n_lines.alias("n_lines"), *[v.alias(c) for c, v in hits.items()])
