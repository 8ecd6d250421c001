import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from codeassay.llm import words as w
from odd_rows import TEXTS, words


@pytest.mark.parametrize("k", (1, 2, 3, 5, 10, 35, 64))
def test_window_hash_is_the_polynomial(k):
    h = np.random.default_rng(k).integers(0, 2**63, 200).astype(np.uint64)
    base, expected = int(w.BASES[0]), []
    for i in range(200 - k + 1):
        value = 0
        for x in h[i : i + k]:
            value = (value * base + int(x)) % 2**64
        expected.append(value)
    assert (w.window_hashes(h, k) == w.mix(np.array(expected, np.uint64))).all()
    assert len(w.window_hashes(h[: k - 1], k)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\n\t\x0b\x1c😀", max_size=12)), max_size=12), st.integers(1, 40))
def test_words_of_all_texts_whatever_the_slices(texts, most):
    found, hashes = [], {}
    for part in w.slices(pa.array(texts, pa.string()), most):
        x = w.words_of(part)
        for i in range(part.count):
            span = range(x.bounds[i], x.bounds[i + 1])
            own = [part.data[x.start[j] : x.end[j]].decode() for j in span]
            found.append(own)
            for word, j in zip(own, span):
                assert hashes.setdefault(word, x.hash[j]) == x.hash[j]
    assert found == [words(x) for x in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_letters_and_digits_are_words_of_their_own_kind():
    (part,) = w.slices(pa.array(["It's 3-fold: Über,x"]))
    x = w.words_of(part, w.ALNUM, lower=True)
    low = part.data.translate(w.LOWER)
    assert [low[a:b].decode() for a, b in zip(x.start, x.end)] == ["it", "s", "3", "fold", "Über", "x"]


def test_long_words_differ_by_their_ends():
    a, b = "y" * 9000 + "1", "y" * 9000 + "2"
    (part,) = w.slices(pa.array([f"{a} {b} {a}"]))
    h = w.words_of(part).hash
    assert h[0] == h[2] != h[1]


def test_covered_and_inside():
    assert w.covered(np.array([1, 2, 6]), 3, 9).tolist() == [False, True, True, True, True, False, True, True, True]
    assert w.inside_text(np.array([0, 2, 2, 6]), 3).tolist() == [2, 3]


def test_sizes_do_not_change_hashes():
    texts = [x for _, x in TEXTS]
    random.Random(1).shuffle(texts)
    one = np.concatenate([w.words_of(p).hash for p in w.slices(pa.array(texts), 10)])
    two = np.concatenate([w.words_of(p).hash for p in w.slices(pa.array(texts), 1 << 30)])
    assert (one == two).all()
