import collections

import pytest

from codeassay.llm import substrings
from odd_rows import TEXTS, near_copies, no_documents, odd_documents, words


def expected(texts, k):
    own = [(i, words(x)) for i, x in texts]
    seen = collections.Counter(tuple(w[a : a + k]) for _, w in own for a in range(len(w) - k + 1))
    out = []
    for i, w in own:
        keep = [True] * len(w)
        for a in range(len(w) - k + 1):
            if seen[tuple(w[a : a + k])] > 1:
                keep[a : a + k] = [False] * k
        out.append((i, len(w), len(w) - sum(keep), " ".join(x for x, y in zip(w, keep) if y)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", (1 << 22, 40_000, 500))
def test_like_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", block)
    texts = [*TEXTS, *((100 + i, x) for i, x in near_copies())]
    out = substrings.remove_repeats(odd_documents(spark, texts), window=6, block_bytes=block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out), key=repr) == expected(texts, 6)
    for r in out:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_repeats_in_one_text_and_no_texts(spark):
    text = " ".join(["p q r s"] * 3)
    out = substrings.remove_repeats(odd_documents(spark, [(1, text), (2, "p q r")]), window=4).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {1: 12, 2: 0}
    assert substrings.remove_repeats(no_documents(spark)).count() == 0
