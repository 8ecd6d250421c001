import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from codeassay.llm import packing, tokens
from codeassay.llm.bpe import Encoder, public_vocabulary
from odd_rows import LONG, TEXTS, no_documents, odd_documents, rows

VOCABULARY = public_vocabulary()
PIECES = st.sampled_from(["a", "'", "s", "'s", "'re", "'ll", "'d", " ", "  ", "\n", "\t", "7", "é", "!", "ve", "Z", "\r\n", "½", "\x85", "\x1c", "日", "<|endoftext|>", "ß", "_"])
TEXT = st.lists(PIECES, max_size=30).map("".join)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY)


def library(text):
    return VOCABULARY.library().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_ids_are_the_librarys(texts):
    encoder = Encoder(VOCABULARY)
    assert [x.tolist() for x in encoder.ids(texts)] == [library(x) for x in texts]
    assert encoder.lengths(texts).tolist() == [len(library(x)) for x in texts]


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 20), st.integers(1, 6))
def test_splicing_is_exact_for_any_chunks(text, size, overlap):
    assert tokens.spliced_count(text, Encoder(VOCABULARY), tokens.Chunks(size, overlap)) == len(library(text))


def test_overlap_widens_where_nothing_is_stable(encoder):
    for text in ("x" * 3000, "日本" * 2000, " " * 3000, "<|endoftext|>" * 300, "a  b" * 800, LONG[:9000]):
        assert tokens.spliced_count(text, encoder, tokens.Chunks(400, 8)) == len(library(text))


def test_counts_of_odd_rows(spark):
    found = rows(tokens.with_token_counts(odd_documents(spark), chunks=tokens.Chunks(5000, 64)), "doc_id", "n_bytes", "n_tokens")
    assert found == sorted(((i, len((x or "").encode()), len(library(x))) for i, x in TEXTS), key=repr)
    assert tokens.with_token_counts(no_documents(spark)).count() == 0


def check_packed(found, texts, size):
    ids = {}
    for i, x in texts:
        ids.setdefault(i, []).append(np.array([*library(x), 1], "<u4"))
    whole = sorted(zlib.crc32(x[a : a + size].tobytes()) for own in ids.values() for x in own for a in range(0, len(x), size))
    assert sorted(r["ids_crc32"] for r in found) == whole
    for r in found:
        fits = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in fits)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return by_sequence


@pytest.mark.parametrize("shard", (100_000, 2))
def test_packing_of_odd_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "RANKED_ROWS", shard)
    found = packing.packed_documents(odd_documents(spark), sheet=packing.Sheet(size=64, step=4)).collect()
    check_packed(found, TEXTS, 64)
    assert packing.packed_documents(no_documents(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=200))
def test_patterns_hold_every_piece(lengths):
    bins, n = np.unique(lengths, return_counts=True)
    patterns = packing.whole_patterns(bins, n, 64, packing.Sheet())
    assert (sum(p * x for p, x in patterns) == n).all()
    assert all((p * bins).sum() <= 64 for p, _ in patterns)
    places = packing.places(patterns, bins)
    for b, k in zip(bins, n):
        ranks = sorted((low, end) for at, low, end, *_ in places if at == b)
        assert [x for low, end in ranks for x in range(low, end)] == list(range(k))


def test_columns_beat_largest_first():
    # Pieces of 48 % and 26 %: largest first pairs 48 with 48, the program mixes them.
    size, demand = np.array([26, 48, 35, 17]), np.array([4000, 4000, 2000, 3000])
    order = np.argsort(size)
    used = sum(n for _, n in packing.whole_patterns(size[order], demand[order], 100, packing.Sheet()))
    _, first = packing.first_basis(size[order], demand[order].astype(float), 100)
    assert (size * demand).sum() / 100 <= used <= first.sum() + len(size)


def test_inverse_without_a_library():
    a = np.random.default_rng(3).random((40, 40))
    assert np.allclose(packing.inverse_of(a) @ a, np.eye(40))
