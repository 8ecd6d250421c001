"""The whole pipeline against brute force: each stage by its plain definition, on what the one before it left."""

import random

import corpus_pipeline
from codeassay.llm import quality
from odd_rows import WORD
from test_llm_decontaminate import expected as hits
from test_llm_jaccard import expected as components
from test_llm_lines import expected as lines_left
from test_llm_quality import CHINESE, ENGLISH, RUSSIAN, counts, random_letters
from test_llm_tokens import check_packed

SYLLABLES = ("th", "er", "on", "an", "re", "il", "os", "ma", "ke", "tu", "vi", "do")


def prose(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus():
    """(doc_id, text): for each stage some documents that it takes out, or takes something out of."""
    rng, texts = random.Random(12), [ENGLISH, RUSSIAN, CHINESE + " " + ENGLISH, None, "", "too short to stay", "again and again " * 60]
    texts += [random_letters(4000, 3)[0].decode(), random_letters(3000, 4)[3].decode()]
    # Lines that repeat, exactly and but for one character, within a text and across texts.
    lines = [" ".join(prose(rng, 14)) for _ in range(12)]
    for _ in range(8):
        own = [x if rng.random() < 0.5 else x[:9] + "z" + x[9 + rng.randrange(2) :] for x in rng.sample(lines, 5)]
        texts.append("\n".join([" ".join(prose(rng, 60)), *own, own[0], ""]))
    texts.append("\n".join(lines))
    texts.append(texts[-2])
    # Near copies on one line each: no line rule meets them, the shingles do; some lie just beyond 0.8.
    for size in (90, 150, 400):
        base = prose(rng, size)
        for k in (0, 1, 2, 3, 4, 6, 9):
            own = base[:]
            for at in rng.sample(range(size), k):
                own[at] = "q" + own[at] + "x"
            texts.append(" ".join(own))
    # Passages of the benchmark, whole and cut short, and a text of many sequences.
    items = [" ".join(prose(rng, n)) for n in (40, 12, 10, 6)] + [None, ""]
    for own in (items[0], items[1].upper(), items[2], items[3], " ".join(items[0].split()[5:14]), " ".join(items[0].split()[5:15])):
        texts.append(" ".join([*prose(rng, 70), own, *prose(rng, 30)]))
    texts.append(" ".join(prose(rng, 6000)))
    texts += [" ".join(prose(rng, rng.randint(55, 900))) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts, start=100)), list(enumerate(items))


def brute_force(docs, items):
    """Documents after each of the first four stages."""
    judge = quality._Ratios(quality.Bands()).judge
    after = []
    good = []
    for i, x in docs:
        n, _, _, _, repeated = counts(x)
        if n >= 50 and 100 * repeated <= 50 * n and judge(x.encode())[-1]:
            good.append((i, x))
    after.append(good)
    after.append([(i, x) for i, x, _, _ in lines_left(good, good) if WORD.search(x)])
    least = {i: c for i, _, c, _ in components(after[-1])}
    after.append([(i, x) for i, x in after[-1] if least[i] in (i, None)])
    hit = {i for i, _, n, _ in hits(after[-1], items) if n}
    after.append([(i, x) for i, x in after[-1] if i not in hit])
    return after


def test_pipeline_like_brute_force(spark, tmp_path):
    docs, items = corpus()
    after = brute_force(docs, items)
    sizes = [len(docs), *map(len, after)]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and sizes[-1] >= 20
    sf = str(tmp_path)
    table = spark.createDataFrame([(i, "s", None, x, len(x or "")) for i, x in docs], "doc_id bigint, source string, lang string, text string, n_chars bigint")
    table.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, x) for i, x in items], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, after):
        out = stage(spark, docs, sf)
        assert out.columns == table.columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert sorted(map(tuple, docs.select("doc_id", "text", "n_chars").collect())) == sorted((i, x, len(x)) for i, x in want), name
    packed = corpus_pipeline.run(spark, sf).collect()
    check_packed(packed, after[-1], 2048)
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())
