"""Byte-level BPE for many whole texts at once.

The pattern that splits text before merges only looks at classes of
characters, and merges never leave a piece.  So pieces are found for a whole
slice with array operations, equal pieces are merged once, and results are kept
in the worker.  Texts with characters outside the table of classes, or with the
string of a special token, go to the tokenizers library as they are.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd

from .words import word_hashes, worker_cache

#: Fixed values of the vocabulary.
SPECIAL = "<|endoftext|>"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points whose classes no version of Unicode has changed.
TABLE = 0x0370
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Pieces whose ids a worker keeps, as bytes: about fifty megabytes.
KEPT_PIECES = 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """Paths of the vocabulary: the file of the tokenizers library, and the same vocabulary as ranks."""

    json: str
    ranks: str

    def library(self):
        """The library's tokenizer, one for a worker, without threads of its own: Spark has the cores."""
        if self.json not in (cache := worker_cache().setdefault("tokenizers", {})):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            cache[self.json] = Tokenizer.from_file(self.json)
            cache[self.json].no_truncation()
            cache[self.json].no_padding()
        return cache[self.json]

    def merger(self):
        if self.ranks not in (cache := worker_cache().setdefault("mergers", {})):
            import tiktoken

            with open(self.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cache[self.ranks] = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        return cache[self.ranks]


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def classes() -> np.ndarray:
    """Class of each code point of the table."""
    if "classes" not in (cache := worker_cache()):
        kinds = np.full(TABLE, OTHER, np.uint8)
        for i in range(TABLE):
            general = unicodedata.category(chr(i))[0]
            kinds[i] = LETTER if general == "L" else NUMBER if general == "N" else OTHER
        kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = SPACE
        cache["classes"] = kinds
    return cache["classes"]


def piece_starts(codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the texts between the cuts; all code points lie in the table.

    A piece is a contraction, a run of letters, of numbers or of other
    characters, each with one blank before it, or white space.  White space
    before a text's next word leaves its last character to that word if it is
    a blank, and by itself if not.
    """
    n = len(codes)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[cuts] = True
    last = first[1:]
    change = np.empty(n, bool)
    change[0], change[1:] = True, kind[1:] != kind[:-1]
    change |= first[:-1]
    space = kind == SPACE
    follows = np.zeros(n, bool)  # the next character is of the same text and not white space
    follows[:-1] = ~space[1:] & ~last[:-1]
    tail = space & follows  # the last character of white space before a word
    glued = np.zeros(n, bool)  # the character before is a blank that belongs to this run
    glued[1:] = (tail & (codes == 32))[:-1]
    start = (change & ~glued) | tail
    # contractions: an apostrophe that begins a piece and a listed ending behind it
    mark = np.flatnonzero((codes == 39) & change & ~glued)
    if len(mark):
        end_of_text = np.repeat(cuts[1:], np.diff(cuts))
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        done = np.zeros(len(mark), bool)
        for ending in CONTRACTIONS:
            fits = ~done & (mark + len(ending) < end_of_text[mark])
            for k, c in enumerate(ending):
                fits &= padded[mark + 1 + k] == ord(c)
            done |= fits
            start[mark[fits] + 1] = False
            after = mark[fits] + 1 + len(ending)
            after = after[after < n]
            start[after] |= kind[after] == LETTER
    return np.flatnonzero(start)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each is first, and for every key the number of its distinct one."""
    which, found = pd.factorize(keys)
    first = np.empty(len(found), np.int64)
    first[which[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return found, first, which


def sizes_of(entries: list[bytes]) -> np.ndarray:
    """Number of ids of each entry."""
    return np.fromiter(map(len, entries), np.int64, len(entries)) // 4


class Encoder:
    """Ids, or only their number, of many texts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[int, bytes] = worker_cache().setdefault(f"pieces {vocabulary.ranks}", {})

    def plain(self, texts: list[str]) -> list[bool]:
        """Whether the table of classes covers a text and no special string is in it."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out, whole = np.ones(len(texts), bool), "".join(texts)
        far = np.flatnonzero(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32) >= TABLE)
        out[np.searchsorted(np.cumsum(sizes), far, "right")] = False
        if SPECIAL in whole:
            out &= [SPECIAL not in x for x in texts]
        return out.tolist()

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of plain texts: bounds of each text's pieces, number of each piece's entry, and the entries (ids of four bytes each)."""
        whole = "".join(texts)
        codes = np.frombuffer(data := whole.encode("utf-16-le"), np.uint16)
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        if not len(codes):
            return np.zeros(len(cuts), np.int64), np.zeros(0, np.int64), []
        starts = piece_starts(codes, cuts)
        ends = np.append(starts[1:], len(codes))
        hashes, at, which = distinct(word_hashes(data, 2 * starts, 2 * ends))
        known, merge, entries = self.known, self.vocabulary.merger(), []
        if len(known) > KEPT_PIECES:  # bounds memory; a piece that goes is merged again when it comes back
            known.clear()
        for key, a, b in zip(hashes.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
            ids = known.get(key)
            if ids is None:
                ids = known[key] = array("I", merge.encode_ordinary(whole[a:b])).tobytes()
            entries.append(ids)
        return np.searchsorted(starts, cuts), which, entries

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        out, simple = np.zeros(len(texts), np.int64), [i for i, x in enumerate(self.plain(texts)) if x]
        bounds, which, entries = self.pieces([texts[i] for i in simple])
        sizes = sizes_of(entries)
        total = np.concatenate([[0], np.cumsum(sizes[which])])
        out[simple] = np.diff(total[bounds])
        for i in set(range(len(texts))) - set(simple):
            out[i] = len(self.vocabulary.library().encode(texts[i], add_special_tokens=False).ids)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        simple = [i for i, x in enumerate(self.plain(texts)) if x]
        bounds, which, entries = self.pieces([texts[i] for i in simple])
        sizes = sizes_of(entries)
        flat = np.frombuffer(b"".join(entries), np.uint32)
        begin, each = (np.cumsum(sizes) - sizes)[which], sizes[which]
        into = np.cumsum(each) - each
        ids = flat[np.arange(int(each.sum())) + np.repeat(begin - into, each)]
        edges = np.append(into, len(ids))[bounds] if len(which) else np.zeros(len(bounds), np.int64)
        for k, i in enumerate(simple):
            out[i] = ids[edges[k] : edges[k + 1]]
        for i in set(range(len(texts))) - set(simple):
            out[i] = np.array(self.vocabulary.library().encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def marks(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, where its pieces (or the library's tokens) begin, and the ids before each of them; the last entry is the end."""
        out: list = [None] * len(texts)
        simple = [i for i, x in enumerate(self.plain(texts)) if x]
        for i in simple:
            bounds, which, entries = self.pieces([texts[i]])
            sizes = sizes_of(entries)[which]
            lengths = self._piece_starts(texts[i])
            out[i] = np.append(lengths, len(texts[i])), np.concatenate([[0], np.cumsum(sizes)])
        for i in set(range(len(texts))) - set(simple):
            begins = np.array([a for a, _ in self.vocabulary.library().encode(texts[i], add_special_tokens=False).offsets], np.int64)
            out[i] = np.append(begins, len(texts[i])), np.arange(len(begins) + 1)
        return out

    @staticmethod
    def _piece_starts(text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        return piece_starts(codes, np.array([0, len(codes)])) if len(codes) else np.zeros(0, np.int64)
