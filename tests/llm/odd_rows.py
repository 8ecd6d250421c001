"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random
import re

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG), (None, "a b c"), (None, None),
    (7, "same row twice over and over again"), (7, "same row twice over and over again"), (8, "Same row twice over and over again"), (8, "another text of this id"),
    (9, "Ünï çödé 日本語 😀 words"), (10, "x"), (11, "a" * 5000), (12, "one two three four five six seven eight nine ten eleven twelve"),
    (13, "line one here is long enough\nline one here is long enough\n\nline two here is long enough"), (14, "tail \x1c\x85\xa0 odd <|endoftext|> blanks"),
]
SCHEMA = "doc_id bigint, text string, lang string, k int, t string, block int, kept string, row string, n int, fates string, row_key string, length string"


def odd_documents(spark, texts=TEXTS):
    rows = [(i, x, "en" if n % 2 else None, n, "t", 3, "yes", "r", 7, "f", "q", "l") for n, (i, x) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def near_copies(n_groups=6, copies=8, words=60, seed=5):
    """Random texts with copies in which some words differ."""
    rng, out = random.Random(seed), []
    for _ in range(n_groups):
        base = [f"v{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            own = base[:]
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                own[rng.randrange(words)] = f"z{rng.randrange(50)}"
            out.append((len(out), " ".join(own)))
    return out


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
