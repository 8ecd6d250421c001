import hashlib
import re

import pytest

from codeassay.llm.infill import Infill, PieceTable, inverse, restored, with_infill, with_restored
from odd_rows import TEXTS, no_documents, odd_documents, rows

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
MORE = [(100 + i, x) for i, x in enumerate(["a", " a", "a ", "  ", "a b c d e f g h i j", "holds <P> already", "ends <S", "S> begins", "<M", "a <S b> c", "\n\n x \t y\x0b", "Ünï 日本 😀 z " * 50])] + [
    (200 + i, " ".join(f"w{j}" for j in range(i))) for i in range(1, 60)
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(key, text):
    text = text or ""
    units = UNIT.findall(text)
    h = [int(sha(f"42:{'' if key is None else key}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, len(units), "plain", None, None, text, sha(text), sha(text)
    spm = h[3] % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return key, len(units), "spm" if spm else "psm", len(p), len(m), out, sha(out), sha(text)


def test_like_brute_force(spark):
    texts = TEXTS + MORE
    out = with_restored(with_infill(odd_documents(spark, texts).drop("n")))
    assert rows(out, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256") == sorted((expected(*x) for x in texts), key=repr)
    assert rows(out, "doc_id", "restored") == sorted(((i, x or "") for i, x in texts), key=repr)
    assert {r["form"] for r in out.select("form").collect()} == {"plain", "psm", "spm"}


def test_clashing_and_empty(spark):
    docs = odd_documents(spark).withColumnRenamed("kept", "Form").withColumnRenamed("row", "output")
    out = with_infill(docs)
    assert [c for c in out.columns if c.lower() == "form"] == ["form"] and out.count() == len(TEXTS)
    assert with_restored(with_infill(no_documents(spark))).count() == 0
    with pytest.raises(ValueError):
        with_infill(docs.withColumnRenamed("k", "form2").withColumnRenamed("block", "FORM3"), text="output")


def test_tables():
    table = PieceTable.of(b"abcdef", b"<P>").cut(4).cut(0).cut(6).cut(2)
    assert [table.text()] + [bytes(x) for x in table.stream()] == ["abcdef", b"", b"ab", b"cd", b"ef", b""]
    for order in ((3, 0, 5, 2, 4, 1), (5, 2, 3, 0, 4, 1)):
        assert [order[i] for i in inverse(order)] == list(range(6))
    assert table.arranged((4, 3, 2, 1, 0)).sha256() == hashlib.sha256(b"efcdab").hexdigest()


def test_empty_parts_are_restored():
    rule = Infill()
    for p in ("", "a ", "<", "<S", "é"):
        for m in ("", "b ", ">", "P>"):
            for s in ("", "c", "M>", "<M"):
                if any(x in p + m + s for x in ("<P>", "<S>", "<M>")):
                    continue
                assert restored(f"<P>{p}<S>{s}<M>{m}".encode(), "psm", rule).text() == p + m + s
                assert restored(f"<S>{s}<P>{p}<M>{m}".encode(), "spm", rule).text() == p + m + s
