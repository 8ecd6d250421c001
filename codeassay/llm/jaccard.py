"""Exact Jaccard join of shingle sets with skipping by relations between sets.

Equal sets are one node.  Sets are ordered by how often their shingles occur
(counted exactly over all texts, see ``blocks``), rare ones first; two sets above
the threshold then share a shingle of their prefixes.  Shingles that occur once
link nothing, so the index of prefixes is small.  Its postings keep the place of
the shingle in its set.  Lists are skipped in blocks by position: a list is cut
by size and place, and a pair of blocks whose sets cannot overlap enough even if
all that follows the place were shared is skipped whole.  For the first shingle
that two sets share this bound holds exactly, so no link is lost.  Lists join sets
into families, and only within families are overlaps counted.

There the answers of a set are derived from those of a similar set: of the sets
not answered yet the one most similar to an answered set comes next; its
overlaps with all others are the answered set's, less the lists of the shingles
that it lacks, plus the lists of those that only it has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.session import cut_lineage
from .blocks import BLOCK_BYTES, BUCKET_BYTES, classes_of, in_blocks, repeat_classes, with_answers
from .components import connected_components
from .keys import fresh, row_key, without
from .packing import ranked
from .words import give_back, mix, slices, window_hashes, words_of

#: Sets of a family that one task compares with each other or with as many more.
PART_SETS = 1000
#: Blocks by place that a list of one band of sizes is cut into.
STEPS = 8
SETS = "k {kind}, block int, n_shingles bigint, sid string, place int, tokens array<bigint>"


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and the bounds of each text's set."""
    sets, sizes = [], []
    for part in slices(column):
        words = words_of(part, lower=True)
        hashes = window_hashes(words.hash, k)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if b - a >= k:
                found = np.unique(hashes[a : b - k + 1])
            elif b > a:  # the whole sequence is the one shingle; its length keeps it apart from others
                found = mix(window_hashes(words.hash[a:b], b - a) + np.uint64(b - a))
            else:
                found = np.empty(0, np.uint64)
            sets.append(found)
            sizes.append(len(found))
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def distinct_shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = np.unique(shingle_sets(column, k)[0], return_counts=True)
    return keys, mix(keys ^ np.uint64(0xA0761D6478BD642F)), counts


def set_id(shingles: np.ndarray) -> str | None:
    """Digest of a set, 128 bits; None for the empty set."""
    if not len(shingles):
        return None
    one, two = np.bitwise_xor.reduce(mix(shingles)), np.add.reduce(mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)))
    return f"{int(one):016x}{int(two):016x}"


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def overlaps(tokens: np.ndarray, index: tuple[np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """How often each set occurs in the lists of the tokens."""
    starts, members = index
    begin, size = starts[tokens], starts[tokens + 1] - starts[tokens]
    into = np.cumsum(size) - size
    return np.bincount(members[np.arange(int(size.sum())) + np.repeat(begin - into, size)], minlength=m)


def compare(sets: list[np.ndarray], part: np.ndarray, weight: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between sets of different parts, or of the only part: edges that span them, and for each set the copies it links to."""
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    which, known = pd.factorize(np.concatenate(sets))
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(which, kind="stable")
    index = np.searchsorted(which[order], np.arange(len(known) + 1)), owner[order]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    cross = len(np.unique(part)) > 1
    root, edges, links = list(range(m)), [], np.zeros(m, np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tokens = [np.sort(which[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    answered = np.empty((m, m), np.int32)  # overlaps of the sets answered so far with all sets
    left, best, like = np.ones(m, bool), np.zeros(m), np.full(m, -1)  # for each set the most similar answered one
    for _ in range(m):
        x = int(np.argmax(np.where(left, best, -1.0)))
        left[x] = False
        own, counts = tokens[x], None
        if like[x] >= 0:
            other = tokens[like[x]]
            gone, more = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
            if len(gone) + len(more) < len(own):
                counts = answered[like[x]] - overlaps(gone, index, m) + overlaps(more, index, m)
        if counts is None:
            counts = overlaps(own, index, m)
        answered[x] = counts
        similar = counts / (sizes + sizes[x] - counts)
        closer = left & (similar > best)
        best[closer], like[closer] = similar[closer], x
        linked = 100 * counts >= percent * (sizes[x] + sizes - counts)
        linked[x] = False
        if cross:
            linked &= part != part[x]
        found = np.flatnonzero(linked)
        links[x] = weight[found].sum()
        for y in found.tolist():
            if (a := find(x)) != (b := find(y)):
                root[a] = b
                edges.append((x, y))
    return edges, links


def set_table(docs: DataFrame, key: str, text: str, k: int, percent: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """For each row of ``docs`` its set's size, digest and those prefix shingles that occur elsewhere, from their place on; and the blocks of texts."""
    blocks, n, total = in_blocks(docs, {key: "k"}, text, block_bytes)
    buckets = max(1, -(-total * 2 // BUCKET_BYTES))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, word, _ = distinct_shingles(left["t"], k)
        classes = classes_of(right, keys, word, buckets)
        shingles, bounds = shingle_sets(left["t"], k)
        kind = classes[np.searchsorted(keys, shingles)]
        sizes, ids, places, tokens = np.diff(bounds), [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own, its = shingles[a:b], kind[a:b]
            ids.append(set_id(own))
            once = int((its == 0).sum())  # those come first
            rest = prefix_length(b - a, percent) - once if b > a else 0
            places.append(once)
            if rest > 0:
                shared = np.flatnonzero(its)
                order = np.lexsort((own[shared], its[shared]))[:rest]
                tokens.append(own[shared[order]].view(np.int64))
            else:
                tokens.append(np.empty(0, np.int64))
        return pa.table({
            "k": left["k"], "block": left["block"], "n_shingles": pa.array(sizes, pa.int64()), "sid": pa.array(ids, pa.string()),
            "place": pa.array(places, pa.int32()), "tokens": pa.array(tokens, pa.list_(pa.int64())),
        })

    answers = repeat_classes(blocks, lambda column: distinct_shingles(column, k), buckets)
    kind = docs.schema[key].dataType.simpleString()
    return with_answers(blocks, answers, work, SETS.format(kind=kind)), blocks


def postings_of(sets: DataFrame, percent: int) -> DataFrame:
    """(token, band, step, node, size, rest): the list of each shingle, cut by set size and by the place of the shingle in its set.

    ``rest`` counts the shingles from this place on, the most that sets can share if this is the first that they do.
    """
    size = F.col("n_shingles")
    band = F.floor(F.log(size) / math.log(100 / percent) + 1e-9).cast("int")
    each = sets.select(F.xxhash64("sid").alias("node"), size, "place", F.posexplode("tokens").alias("i", "token"))
    place, prefix = F.col("place") + F.col("i"), size - F.ceil(percent * size / 100) + 1
    return each.select("token", band.alias("band"), F.floor(STEPS * place / prefix).cast("int").alias("step"), "node", size.alias("size"), (size - place).alias("rest"))


def live_blocks(postings: DataFrame, percent: int) -> DataFrame:
    """(token, band, step, first, others): blocks that hold a possible pair, with the first set of each block they can pair with; the rest is skipped.

    The blocks of a list are bounded by the bands of sizes times ``STEPS``.
    """
    block = postings.groupBy("token", "band", "step").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.max("rest").alias("rest"), F.min("size").alias("low"))
    fields = F.struct("band", "step", "first", "n", "rest", "low")
    lists = block.groupBy("token").agg(F.collect_list(fields).alias("list"), F.sum("n").alias("n")).filter("n > 1")
    a = F.col("a")

    def meets(b):
        same = (b["band"] == a["band"]) & (b["step"] == a["step"])
        reach = (100 + percent) * F.least(a["rest"], b["rest"]) >= percent * (a["low"] + b["low"])
        return (F.abs(b["band"] - a["band"]) <= 1) & (~same | (b["n"] > 1)) & reach

    pairs = lists.select("token", "list", F.explode("list").alias("a")).select("token", "a", F.filter("list", meets).alias("b")).filter(F.size("b") > 0)
    return pairs.select("token", "a.band", "a.step", "a.first", F.transform("b", lambda b: b["first"]).alias("others"))


def families(sets: DataFrame, percent: int) -> DataFrame:
    """(node, family) of the sets that meet another in a list block; nodes are hashes of digests, two sets that share one only make a family larger."""
    postings = postings_of(sets, percent)
    live = cut_lineage(live_blocks(postings, percent))
    within = postings.join(live.drop("others"), ["token", "band", "step"]).select(F.col("node").alias("u"), F.col("first").alias("v"))
    across = live.select(F.col("first").alias("u"), F.explode("others").alias("v"))
    return connected_components(within.union(across)).withColumnsRenamed({"component": "family"})


def family_links(blocks: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links within families, by tasks of bounded size: rows (sid, v, links); v is a spanning edge's other end or null.

    ``members``: sid, family, n_shingles, copies, block and key of one text with that set.
    """
    sized = members.groupBy("family").agg(F.count("*").alias("m"))
    large = sized.filter(F.col("m") > PART_SETS)
    total = large.agg(F.sum("m")).first()[0] or 0
    columns = ["sid", "family", "n_shingles", "copies", "block", "k"]
    marked = members.join(sized, "family")
    small = marked.filter(F.col("m") <= PART_SETS).select(*columns, F.lit(0).alias("part"))
    if total:
        big = ranked(marked.filter(F.col("m") > PART_SETS).drop("m"), "family", [F.col("n_shingles"), F.col("sid")], total)
        small = small.union(big.select(*columns, F.floor(F.col("rank") / PART_SETS).cast("int").alias("part")))
    parted = cut_lineage(small)
    # Parts of a family that hold sets of sizes in reach of each other; a part in itself is a pair too.
    span = parted.groupBy("family", "part").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    other = span.select("family", F.col("part").alias("p2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    near = (F.col("part") <= F.col("p2")) & (100 * F.col("high") >= percent * F.col("l2")) & (100 * F.col("h2") >= percent * F.col("low"))
    pairs = span.join(other, "family").filter(near).withColumn("pair", F.concat_ws("-", "family", "part", "p2"))
    sides = pairs.select("family", "part", "pair").union(pairs.select("family", F.col("p2").alias("part"), "pair")).distinct()
    wanted = parted.join(sides, ["family", "part"]).groupBy(*columns, "part").agg(F.collect_list("pair").alias("pairs"))

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {r["sid"]: r for r in right.to_pylist()}
        keys = {r["k"] for r in rows.values()}
        mine = [i for i, x in enumerate(left["k"].to_pylist()) if x in keys]
        shingles, bounds = shingle_sets(left["t"].take(pa.array(mine, pa.int64())), k)
        out = {"pair": [], "sid": [], "part": [], "copies": [], "shingles": []}
        for i in range(len(mine)):
            own = shingles[bounds[i] : bounds[i + 1]]
            row = rows.pop(set_id(own), None)
            if row:
                for pair in row["pairs"]:
                    for name, x in zip(out, (pair, row["sid"], row["part"], row["copies"], own.tobytes()), strict=True):
                        out[name].append(x)
        types = {"pair": pa.string(), "sid": pa.string(), "part": pa.int32(), "copies": pa.int64(), "shingles": pa.binary()}
        return pa.table({name: pa.array(x, types[name]) for name, x in out.items()})

    def link(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table["sid"].to_numpy(), [len(x) for x in table["shingles"].to_pylist()]))))
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        sids = table["sid"].to_pylist()
        edges, links = compare(sets, table["part"].to_numpy(), table["copies"].to_numpy(), percent)
        u = [*sids, *(sids[a] for a, _ in edges)]
        v = [*[None] * len(sids), *(sids[b] for _, b in edges)]
        give_back()
        return pa.table({"u": pa.array(u, pa.string()), "v": pa.array(v, pa.string()), "links": pa.array([*links.tolist(), *[0] * len(edges)], pa.int64())})

    fetched = with_answers(blocks, wanted, fetch, "pair string, sid string, part int, copies bigint, shingles binary")
    return fetched.groupBy("pair").applyInArrow(link, "u string, v string, links bigint")


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id`` and ``n_links``.

    A set holds the distinct k-word shingles of the lower-cased (A-Z) text; a
    text of fewer words is one shingle, a text without words, or null, has the
    empty set and links with nothing.  Texts link when 100 * |A and B| is at
    least ``percent`` * |A or B|; the component is named by its least key.
    ``n_links`` counts the other rows a row links with.  Rows with one key are
    one node: their component is that of all their sets.  A row with a null key
    has links, but its component is null if no other key is in it.  Other
    columns are not carried.  An empty table gives an empty result.
    """
    found, blocks = set_table(docs, key, text, k, percent, block_bytes)
    found = cut_lineage(found)
    filled = found.filter("sid is not null")
    # One text stands for a set; rows with one set are counted before any join.
    sets = filled.groupBy("sid").agg(F.count("*").alias("copies"), F.min_by(F.struct("block", "k", "n_shingles"), F.struct("block", "k")).alias("at"))
    tokens = filled.filter(F.size("tokens") > 0).groupBy("sid", "n_shingles", "place").agg(F.min_by("tokens", "block").alias("tokens"))
    grouped = cut_lineage(families(tokens, percent))
    members = sets.withColumn("node", F.xxhash64("sid")).join(grouped, "node").select("sid", "family", "copies", "at.block", "at.k", "at.n_shingles")
    linked = cut_lineage(family_links(blocks, members, k, percent))
    edges = linked.filter("v is not null").select("u", "v")
    keys = filled.filter("k is not null").select("sid", F.col("k").cast("string").alias("k"))
    repeated = keys.groupBy("k").agg(F.min("sid").alias("v"), F.max("sid").alias("x")).filter("v <> x").select("k", "v")
    same_key = keys.join(repeated, "k").select(F.col("sid").alias("u"), "v")
    component = connected_components(edges.union(same_key)).withColumnsRenamed({"node": "sid"})
    links = linked.groupBy(F.col("u").alias("sid")).agg(F.sum("links").alias("linked"))
    facts = sets.select("sid", "copies", F.col("at.k").alias("_k")).join(component, "sid", "left").join(links, "sid", "left")
    facts = facts.withColumn("component", F.coalesce("component", "sid"))
    least = filled.select("sid", "k").groupBy("sid").agg(F.min("k").alias("least"))
    facts = cut_lineage(facts.drop("_k").join(least, "sid"))
    names = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = facts.join(names, "component").select("sid", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = found.select("k", "n_shingles", "sid").join(facts, "sid", "left")
    return out.select(
        F.col("k").alias(key), "n_shingles", F.coalesce("component_id", "k").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the least by key, then by the text's hash; of rows that repeat both, one.

    Rows with the empty set stay.  Null keys come first.  All columns are kept.
    """
    name = fresh("row_key", docs)
    named = docs.withColumn(name, row_key(key, text))
    found = cut_lineage(jaccard_components(named, name, text, k, percent))
    gone = found.filter(F.col(name) != F.col("component_id")).select(name).distinct()
    repeated = found.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(name)
    return without(named, name, gone, repeated).drop(name)
