import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from codeassay.llm import languages
from odd_rows import TEXTS, no_documents, odd_documents

STEMS = {"aa": ("ka", "to", "mi", "su", "re"), "bb": ("str", "ung", "ich", "ber", "en"), "cc": ("eau", "oi", "tion", "que", "le")}


def prose(stems, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_automaton_knows_all_substrings():
    rng = random.Random(3)
    sequence = [rng.randrange(4) for _ in range(120)]
    step = languages.suffix_automaton(sequence)
    inside = {tuple(sequence[a:b]) for a in range(120) for b in range(a, min(121, a + 9))}
    for _ in range(3000):
        probe = tuple(rng.randrange(4) for _ in range(rng.randint(1, 8)))
        state = 0
        for c in probe:
            state = step[state].get(c, -1) if state >= 0 else -1
        assert (state >= 0) == (probe in inside)


def parsed(text, labelled):
    """Phrases of a greedy parse; a letter that is in no labelled text is one by itself."""
    at, n = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at : at + size + 1] in x for x in labelled):
            size += 1
        n += 1
        at += size
    return n


def test_phrases_are_longest_matches():
    labelled = {k: [prose(s, 40, 1), prose(s, 30, 2)] for k, s in STEMS.items()}
    text = prose(STEMS["bb"], 20, 9)[: languages.SEGMENT]
    for cells in (1 << 22, 0):  # tables of states x letters, and hash tables
        model = languages.Model(labelled, cells)
        symbols = model.symbol[languages.codes_of(text)][:, None].astype(np.int32)
        found = model.phrases(symbols)[:, 0].tolist()
        assert found == [parsed(text, labelled[k]) for k in model.names]
        assert found.index(min(found)) == 1


def test_hash_tables_hold_all_keys():
    rng = np.random.default_rng(4)
    keys = rng.choice(1 << 40, 5000, replace=False)
    table = languages.Hashed.of(keys, np.arange(5000, dtype=np.int32))
    assert (table.find(keys) == np.arange(5000)).all()
    other = np.setdiff1d(rng.choice(1 << 40, 5000), keys)
    assert (table.find(other) == -1).all() and len(languages.Hashed.of(keys[:0], np.empty(0, np.int32)).find(keys)) == 5000


def test_huge_texts_go_in_blocks(monkeypatch):
    labelled = {k: [prose(s, 60, 1)] for k, s in STEMS.items()}
    model = languages.Model(labelled)
    texts = [prose(STEMS["cc"], 900, 3), "", prose(STEMS["aa"], 700, 4), "12", prose(STEMS["bb"], 5, 5)]
    whole = model.predict(texts)
    monkeypatch.setattr(languages, "BLOCK", 2 * languages.SEGMENT)
    assert model.predict(texts) == whole and whole[0] == ["cc", "und", "aa", "und", "bb"]


def test_many_labels_and_large_scripts(spark):
    """A thousand labels and three scripts of thousands of letters: an answer, and a bounded model."""
    rng = random.Random(8)
    stems = {f"l{n:04}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for n in range(1000)}
    rows = [(prose(x, 120, 1), k) for k, x in stems.items()]
    large = {k: [chr(first + i) for i in range(2500)] for k, first in (("x1", 0x4E00), ("x2", 0xAC00), ("x3", 0x1400 - 2500 + 0x280 + 2000))}
    rows += [(" ".join("".join(rng.choice(x) for _ in range(3)) for _ in range(400)), k) for k, x in large.items()]
    docs = spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate(rows)], "doc_id bigint, text string, lang string")
    sample = languages.labelled_sample(docs, F.lit(True), "doc_id", "text", "lang", languages.Sample())
    assert len(sample) == 1003 and sum(len(x) for own in sample.values() for x in own) <= languages.Sample().total
    model = languages.Model(sample)
    held = [x for own in model.languages for x in (own.table, own.start, *((own.hashed.keys, own.hashed.targets) if own.hashed else ())) if x is not None]
    assert sum(x.nbytes for x in [*held, *model.local, model.symbol]) < 300 << 20
    asked = ["l0007", "l0500", "l0999", "x1", "x2"]
    found, _ = model.predict([prose(stems[k], 80, 2) if k in stems else " ".join("".join(rng.choice(large[k]) for _ in range(3)) for _ in range(50)) for k in asked])
    assert found == asked


def test_predictions_of_odd_rows(spark):
    labelled = {k: [prose(s, 60, 1)] for k, s in STEMS.items()}
    texts = [*TEXTS, *((50 + n, prose(s, 30, n)) for n, s in enumerate(STEMS.values())), (60, "12 34 !?"), (61, "日本")]
    out = {r["doc_id"]: r for r in languages.with_language(odd_documents(spark, texts), labelled).collect()}
    assert [out[50 + n]["lang_pred"] for n in range(3)] == list(STEMS)
    assert [out[i]["lang_pred"] for i in (2, 3, 4, 60)] == ["und"] * 4 and out[61]["lang_pred"] in STEMS
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(languages.with_language(odd_documents(spark, texts), labelled).collect()) == len(texts)
    assert languages.with_language(no_documents(spark), labelled).count() == 0
    assert {r["lang_pred"] for r in languages.with_language(odd_documents(spark), {}).collect()} == {"und"}


def test_sample_is_bounded_and_ignores_copies(spark):
    rows = [(i, prose(STEMS["aa"], 50, 1), "aa") for i in range(50)] + [(100 + i, prose(STEMS["bb"], 50, i), "bb") for i in range(9)] + [(200, "x", None), (201, None, "cc"), (202, "12", "dd")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = languages.labelled_sample(docs, F.lit(True), "doc_id", "text", "lang", languages.Sample(texts=4, chars=20))
    assert {k: len(v) for k, v in found.items()} == {"aa": 1, "bb": 4} and all(len(x) <= 20 for v in found.values() for x in v)
    small = languages.labelled_sample(docs, F.lit(True), "doc_id", "text", "lang", languages.Sample(texts=4, chars=20, total=60))
    assert {k: len(v) for k, v in small.items()} == {"aa": 1, "bb": 1}
    assert languages.Sample(4, 20, 60).of(1) == (3, 20) and languages.Sample(4, 20, 60).of(9) == (1, 16)


def test_held_out_accuracy(spark):
    from codeassay.llm.queries import QUERIES

    out = QUERIES["op1_cross_parsing"](spark, "/root/testdata/sf0.01").toPandas()
    truth = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"])
    held = out[out.held_out].merge(truth, on="doc_id")
    assert len(out) == len(truth) and (held.lang == held.lang_pred).mean() > 0.97
