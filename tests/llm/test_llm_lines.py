import random

from codeassay.llm import lines
from odd_rows import TEXTS, WORD, no_documents, odd_documents


def near(a, b):
    """One edit at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def expected(texts, order, least=16):
    """Distinct texts in order; text -> lines left, equal, near."""
    seen, out, fate = [], {}, {}
    for row in order:
        left, equal, close = [], 0, 0
        for x in (row[1] or "").split("\n"):
            if not WORD.search(x):
                left.append(x)
                continue
            if x not in fate:  # what precedes its first place decides
                fate[x] = len(x) >= least and any(len(y) >= least and near(x, y) for y in seen)
            if fate[x]:
                close += 1
            elif x in seen:
                equal += 1
            else:
                left.append(x)
            seen.append(x)
        out[row] = ("\n".join(left), equal, close) if row[1] is not None else (None, 0, 0)
    return sorted(((r[0], *out[r]) for r in texts), key=repr)


def check(spark, texts):
    # A line is judged against all earlier ones, also those of the same text; the order of texts is the operator's.
    docs = odd_documents(spark, texts)
    place = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").distinct().orderBy("doc_id", "h").collect()
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_equal", "n_near"]
    found = sorted(((r["doc_id"], r["text"], r["n_equal"], r["n_near"]) for r in out.collect()), key=repr)
    assert found == expected(texts, [(r["doc_id"], r["text"]) for r in place])


def test_odd_rows(spark):
    check(spark, TEXTS)
    assert lines.dedup_lines(no_documents(spark)).count() == 0


def test_edits_of_all_kinds(spark):
    base = "the quick brown fox jumps 😀 over é dogs"
    edits = [base, base[:-1], "x" + base, base.replace("😀", "😁"), base.replace("quick", "quack"), base[:10] + base[11:], base + "!", base.replace("quick", "quac"), "aa" + base, base.replace("é", "")]
    check(spark, [(i, f"{x}\nend {i}") for i, x in enumerate(edits)])
    check(spark, [(9 - i, f"{x}\nend {i}") for i, x in enumerate(edits)])


def test_random_lines(spark):
    rng, pool = random.Random(8), []
    for _ in range(12):
        x = "".join(rng.choice("ab ") for _ in range(rng.randint(14, 22)))
        for _ in range(10):
            y = list(x)
            for _ in range(rng.choice((0, 1, 1, 2))):
                k = rng.randrange(len(y))
                y[k : k + rng.choice((0, 1))] = rng.choice(("", "a", "c", "b"))
            pool.append("".join(y))
    rng.shuffle(pool)
    check(spark, [(i, "\n".join(pool[5 * i : 5 * i + 5])) for i in range(24)])


def test_no_python_in_the_plan(spark):
    docs = odd_documents(spark)
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
