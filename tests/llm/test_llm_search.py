import collections
import math
import re

import numpy as np
import pytest

from codeassay.llm.search import EXACT, Best, Tiles, column_tiles, item_tiles, length_part, ranked_search
from odd_rows import LONG, TEXTS, lower, near_copies, no_documents, odd_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = [
    (1, "One two THREE, w5x5 w6x6"), (2, "nine ten eleven"), (2, "row twice over"), (3, None), (4, ""), (5, "?!"), (None, "another text of this"), (6, "same row same row"),
    (7, " ".join(LONG.split()[500:560])), (8, "日本語 words ünï"), (9, "nothing holds thesewords"), (10, "v1 v2 v3 v4 v5 v6 v7 v8 v9"), (11, "z1 z2 z3 v10 v11"), (12, "a b c"),
]


def expected(texts, items, k=10):
    docs = [(i, collections.Counter(TERM.findall(lower(x)))) for i, x in texts]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    asked = collections.defaultdict(set)
    for i, x in items:
        asked[i] |= set(TERM.findall(lower(x)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in docs:
            m, s = 10 + 90 * sum(c.values()) * n_docs // n_terms, 0
            for t in terms & set(c):
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("tiles", (Tiles(), Tiles(items=2, columns=3, documents=2, pairs=20)))
def test_like_brute_force(spark, tiles):
    texts = TEXTS + [(1000 + i, x) for i, x in near_copies(8, 12)]
    docs = odd_documents(spark, texts).withColumnRenamed("n", "rank").withColumnRenamed("kept", "score").repartition(5)
    items = spark.createDataFrame([(i, x, 1) for i, x in ITEMS], "item_id bigint, text string, rank int")
    out = ranked_search(docs, items, tiles=tiles)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(out) == expected(texts, ITEMS)


def test_ties_go_by_key(spark):
    texts = [(i, "same words here") for i in range(400, 0, -1)] + [(500, "other")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    items = spark.createDataFrame([(1, "same words")], "item_id bigint, text string")
    assert [r["doc_id"] for r in ranked_search(docs, items, k=25).orderBy("rank").collect()] == list(range(1, 26))


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for docs, asked in ((no_documents(spark), items), (odd_documents(spark), items.limit(0)), (odd_documents(spark, [(1, None), (2, "!")]), items)):
        out = ranked_search(docs, asked)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_sums_stay_exact():
    impact = np.array([EXACT // 3, EXACT // 3, EXACT // 3, EXACT // 2, EXACT - 1, 5, 6])
    cut = column_tiles(np.arange(7), impact, 100)
    assert [b for a, b in cut][-1] == 7 and all(sum(impact[a:b].tolist()) < EXACT for a, b in cut)
    with pytest.raises(OverflowError):
        column_tiles(np.arange(1), np.array([EXACT]), 100)
    tiles = item_tiles(np.array([0, 0, 1, 2, 2]), np.array([3, 1, 3, 0, 1]), np.full(4, 1000), Tiles(items=2, columns=1))
    assert [t.items.tolist() for t in tiles] == [[0, 1], [2]] and [c[0].tolist() for c in tiles[0].columns] == [[1], [3]]
    assert length_part(np.array([7, 1 << 20]), 1 << 50, 1 << 60).tolist() == [10 + 90 * 7 * (1 << 50) // (1 << 60), 10 + 90 * (1 << 70) // (1 << 60)]


def test_best_keeps_ties():
    best = Best(2, 3)
    best.add(np.array([0, 1]), np.array([[5, 5, 5, 5, 9], [0, 0, 1, 0, 0]]), [9, 3, None, 4, 7])
    best.add(np.array([0, 1]), np.array([[5, 4], [0, 0]]), [1, 2])
    assert list(best.rows()) == [(0, 7, 9), (0, None, 5), (0, 1, 5), (1, None, 1)]
