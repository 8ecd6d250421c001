import collections
import random

import pytest
from pyspark.sql import functions as F

from codeassay.llm import jaccard
from codeassay.llm.components import connected_components
from odd_rows import TEXTS, lower, near_copies, no_documents, odd_documents, rows, words


def roots(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def expected(texts):
    sets = [(i, shingles(x)) for i, x in texts]
    links, edges = collections.Counter(), []
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
        edges += [(a, b) for b in range(a) if sets[a][0] == sets[b][0] is not None and sets[a][1] and sets[b][1]]
    parts = collections.defaultdict(list)
    for a, r in roots(range(len(sets)), edges).items():
        parts[r].append(a)
    out = []
    for own in parts.values():
        least = min((sets[a][0] for a in own if sets[a][0] is not None), default=None)
        out += [(sets[a][0], len(sets[a][1]), least, links[a]) for a in own]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("part", "block"), ((1000, 1 << 22), (5, 3000)))
def test_like_brute_force(spark, monkeypatch, part, block):
    monkeypatch.setattr(jaccard, "PART_SETS", part)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", block)
    texts = [*TEXTS, *((100 + i, x) for i, x in near_copies(5, 14))]
    out = jaccard.jaccard_components(odd_documents(spark, texts), block_bytes=block)
    assert rows(out, "doc_id", "n_shingles", "component_id", "n_links") == expected(texts)


def test_one_of_each(spark):
    texts = [*TEXTS, *((100 + i, x) for i, x in near_copies(3, 6))]
    docs = odd_documents(spark, texts)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == len(set(found)) and set(found) <= set(texts)
    linked = {(a, b) for a in range(len(texts)) for b in range(a) if (x := shingles(texts[a][1])) and (y := shingles(texts[b][1])) and 5 * len(x & y) >= 4 * len(x | y)}
    parts = set(roots(range(len(texts)), linked).values())
    empty = {(i, x) for i, x in texts if not shingles(x)}
    assert len(found) == len([p for p in parts if shingles(texts[p][1])]) + len(empty)


def test_no_documents(spark):
    assert jaccard.jaccard_components(no_documents(spark)).count() == 0
    assert jaccard.one_of_each(no_documents(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "u bigint, v bigint")
    found = {r["node"]: r["component"] for r in connected_components(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert found == roots(nodes, edges if 5 in nodes else [e for e in edges if e != (5, 5)])
    assert connected_components(df.limit(0)).count() == 0


def test_answers_of_similar_sets_are_derived(monkeypatch):
    import numpy as np

    rng, calls = np.random.default_rng(1), []
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.03, rng.integers(0, 2**63, 300).astype(np.uint64), base)) for _ in range(30)]
    real = jaccard.overlaps
    monkeypatch.setattr(jaccard, "overlaps", lambda tokens, index, m: calls.append(len(tokens)) or real(tokens, index, m))
    edges, links = jaccard.compare(sets, np.zeros(30, int), np.ones(30, int), 80)
    exact = [sum(10 * len(np.intersect1d(x, y)) >= 8 * len(np.union1d(x, y)) for y in sets) - 1 for x in sets]
    assert links.tolist() == exact and len(edges) <= 29
    assert sum(calls) < 0.3 * sum(len(x) for x in sets)


def test_answers_come_from_the_most_similar_set(monkeypatch):
    """Groups of copies in turn, all of about one size: the set before in any order of sizes is of another group."""
    import numpy as np

    rng, calls = np.random.default_rng(2), []
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    bases = [fresh(400) for _ in range(5)]
    sets = [np.unique(np.concatenate([bases[i % 5][: 396 - i % 3], fresh(4)])) for i in range(60)]
    real = jaccard.overlaps
    monkeypatch.setattr(jaccard, "overlaps", lambda tokens, index, m: calls.append(len(tokens)) or real(tokens, index, m))
    edges, links = jaccard.compare(sets, np.arange(60) // 30, np.ones(60, int), 80)
    assert links.tolist() == [6] * 60 and len(edges) == 55
    assert sum(n == len(x) for n, x in zip(calls, sets)) <= 5 and sum(calls) < 0.15 * sum(len(x) for x in sets)


def test_list_blocks_are_skipped_by_place(spark):
    """100 shingles each at 80 per cent: 89 must be shared, so a first common shingle after place 11 is too late."""
    own = lambda i: list(range(1000 * i, 1000 * i + 4))
    rows = [("a", 100, 10, [1]), ("b", 100, 5, [*own(1), 1]), ("c", 100, 16, [*own(2), 2]), ("d", 100, 20, [2]), ("e", 100, 0, [3]), ("f", 81, 0, [3]), ("g", 60, 0, [3]),
            ("h", 100, 0, [4]), ("i", 81, 12, [4])]
    sets = spark.createDataFrame(rows, "sid string, n_shingles bigint, place int, tokens array<bigint>")
    postings = jaccard.postings_of(sets, 80)
    assert {(r["token"], r["place"]) for r in postings.select("token", F.expr("size - rest").alias("place")).collect()} >= {(1, 10), (1, 9), (2, 20), (3, 0), (4, 12)}
    live = jaccard.live_blocks(postings, 80).collect()
    assert {r["token"] for r in live} == {1, 3}
    name = {r["n"]: r["sid"] for r in sets.select(F.xxhash64("sid").alias("n"), "sid").collect()}
    parts = collections.defaultdict(set)
    for r in jaccard.families(sets, 80).collect():
        parts[r["family"]].add(name[r["node"]])
    assert sorted(sorted(p) for p in parts.values()) == [["a", "b"], ["e", "f"]]
