import collections
import re

import pytest

from codeassay.llm import decontaminate
from odd_rows import LONG, TEXTS, lower, no_documents, odd_documents, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [
    (1, "One TWO, three four five six seven eight nine ten"), (2, "nine ten eleven"), (2, "row twice over"), (3, None), (4, ""), (5, "?!"), (None, "another text of this"),
    (10, " ".join(LONG.split()[500:560])), (11, " ".join(LONG.split()[500:512])), (12, "日本語"), (13, "no text holds these very many words at all in it"),
]


def expected(texts, items):
    windows = collections.defaultdict(set)
    for i, x in items:
        w = WORD.findall(lower(x))
        m = min(10, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[a : a + m])].add(i)
    out = []
    for i, x in texts:
        w = WORD.findall(lower(x))
        hit, met = [0] * len(w), set()
        for own in windows:
            for a in range(len(w) - len(own) + 1):
                if w[a] == own[0] and tuple(w[a : a + len(own)]) == own:
                    hit[a : a + len(own)] = [1] * len(own)
                    met |= windows[own]
        out.append((i, len(w), sum(hit), sorted(str(y) for y in met if y is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", (1_000_000, 0))
def test_like_brute_force(spark, most):
    items = spark.createDataFrame([(i, x, "k") for i, x in ITEMS], "item_id bigint, text string, k string")
    out = decontaminate.benchmark_hits(odd_documents(spark), items, filter_fingerprints=most)
    assert rows(out, "doc_id", "n_words", "n_hit", "item_ids") == expected(TEXTS, ITEMS)
    for r in out.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]


def test_rows_with_hits_go(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = odd_documents(spark)
    out = decontaminate.without_hits(docs, items)
    assert out.columns == docs.columns
    clean = [r[:1] for r in expected(TEXTS, ITEMS) if not r[2]]
    assert rows(out, "doc_id") == sorted(clean, key=repr)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.benchmark_hits(no_documents(spark), items).count() == 0
    none = decontaminate.benchmark_hits(odd_documents(spark), items.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r["n_hit"] for r in none)


@pytest.mark.parametrize("most", (1_000_000, 0))
def test_a_phrase_in_many_items(spark, monkeypatch, most):
    """Items that begin alike share fingerprints; a text meets the windows that occur in it, and all items that have them."""
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    phrase = "choose the one best answer to this question about a topic"
    items = [(i, f"{phrase} number{i} of list{i % 50} with rest{i % 3} here") for i in range(600)]
    texts = [(1, f"so {phrase} number7 of list7 with other"), (2, "the one best answer to this question about"), (3, f"{phrase}. {phrase}! number599"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    out = decontaminate.benchmark_hits(docs, spark.createDataFrame(items, "item_id bigint, text string"), filter_fingerprints=most)
    assert rows(out, "doc_id", "n_words", "n_hit", "item_ids") == expected(texts, items)
