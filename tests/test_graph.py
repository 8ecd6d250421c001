"""Reachability and chains against a plain walk, with cycles, hubs and more hot keys than a task should hold."""

import collections
import random

import pytest

from codeassay.operators import graph as gr


def graph(seed, n=40, edges=70):
    rng = random.Random(seed)
    out = [(f"s{rng.randrange(2)}", f"k{rng.randrange(n)}", f"k{rng.randrange(n)}") for _ in range(edges)]
    out += [("s0", "hub", f"k{i}") for i in range(n)] + [("s1", f"k{i}", "hub") for i in range(0, n, 3)] + [("s0", "k1", "k1")]
    return out


def walked(edges, seeds, most=None):
    out = collections.defaultdict(list)
    for s, a, b in edges:
        out[s, a].append((s, b))
    known = {x: 0 for x in seeds}
    level, depth = list(known), 0
    while level and (most is None or depth < most):
        depth += 1
        level = sorted({b for a in level for b in out[a]} - set(known))
        known |= {x: depth for x in level}
    return sorted((*x, d) for x, d in known.items())


def chains(edges, targets, max_depth=None, max_paths=None):
    up = collections.defaultdict(set)
    for s, a, b in edges:
        up[s, b].add(a)
    out = []
    for s, target in sorted(set(targets)):
        level, seen, found = {target: (target,)}, {target}, []
        while level:
            found += [c for x, c in level.items() if not up[s, x]]
            if max_depth is not None and len(next(iter(level.values()))) == max_depth:
                break
            best = {}
            for x, c in level.items():
                for p in up[s, x] - seen:
                    best[p] = min(best.get(p, (*c, p)), (*c, p))
            seen |= set(best)
            level = best
        found = sorted(found, key=lambda c: (len(c), c))[:max_paths]
        out += [(s, target, c, i) for i, c in enumerate(found, 1)]
    return sorted(out)


def frames(spark, edges, nodes):
    return spark.createDataFrame(edges, "repo string, parent_key string, child_key string"), spark.createDataFrame(nodes, "repo string, dep_key string")


@pytest.mark.parametrize("hot", (False, True))
def test_reachability(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(gr, "hot_keys", lambda df, keys: [r["h"] for r in df.select(gr.key_hash(keys).alias("h")).distinct().collect()])
    edges, seeds = graph(1), [("s0", "k3"), ("s0", "k3"), ("s1", "k5"), ("s1", "nowhere")]
    e, s = frames(spark, edges, seeds)
    assert sorted(tuple(r) for r in gr.reachability(e, s).select("repo", "dep_key", "depth").collect()) == walked(edges, seeds)
    assert sorted(tuple(r) for r in gr.reachability(e, s, max_rounds=2).select("repo", "dep_key", "depth").collect()) == walked(edges, seeds, 2)
    assert gr.reachability(e.limit(0), s.limit(0)).count() == 0


def test_long_path_in_few_moves(spark):
    edges = [("s0", f"n{i:03}", f"n{i + 1:03}") for i in range(30)]
    e, s = frames(spark, edges, [("s0", "n000")])
    assert sorted(tuple(r) for r in gr.reachability(e, s).select("repo", "dep_key", "depth").collect()) == [("s0", f"n{i:03}", i) for i in range(31)]


@pytest.mark.parametrize("depth, paths, hot", ((None, None, False), (4, 2, True), (3, None, False), (None, 1, False)))
def test_chains(spark, monkeypatch, depth, paths, hot):
    if hot:
        monkeypatch.setattr(gr, "hot_keys", lambda df, keys: [r["h"] for r in df.select(gr.key_hash(keys).alias("h")).distinct().collect()])
    edges = graph(7, n=30, edges=45)
    targets = [("s0", f"k{i}") for i in range(0, 30, 4)] + [("s1", "k2"), ("s1", "hub"), ("s1", "nowhere"), ("s1", "k2")]
    e, t = frames(spark, edges, targets)
    found = gr.dep_chains(e, t, max_depth=depth, max_paths=paths).select("repo", "target", "chain", "rank").collect()
    assert sorted((r[0], r[1], tuple(r[2]), r[3]) for r in found) == chains(edges, targets, depth, paths)
