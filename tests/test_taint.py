import random
import re

from pyspark.sql import functions as F

from codeassay.functions.text import lines_of
from codeassay.operators import files as fi


def fold(lines):
    """Plain statement of the rule: seeds first, then one pass in line order."""
    tainted = []
    for l in lines:
        m = re.match(r"\s*(\w+)\s*=\s*", l)
        if m and re.search(r"\b(?:request\.\w+|input\s*\(|sys\.argv)", l[l.index("=") + 1 :]):
            tainted.append(m[1])
    for l in lines:
        m = re.match(r"\s*(\w+)\s*=", l)
        if m and m[1] not in tainted and set(re.findall(r"\w+", l[l.index("=") + 1 :])) & set(tainted):
            tainted.append(m[1])
    return set(tainted)


def test_python_taint_equals_fold(spark):
    rnd = random.Random(11)
    names = list("abcdefg")
    programs = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(1, 12)):
            rhs = rnd.choice(["request.args", "input()", "1", rnd.choice(names), rnd.choice(names) + " + " + rnd.choice(names), "sys.argv[1]"])
            lines.append("  " * rnd.randint(0, 1) + rnd.choice(names) + rnd.choice([" = ", "=", " == "]) + rhs)
        programs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(programs, "i int, content string").select("i", fi.py_tainted(lines_of(F.col("content"))).alias("t"))
    got = {r.i: set(r.t) for r in df.collect()}
    assert got == {i: fold(c.split("\n")) for i, c in programs}


def test_js_sources(spark):
    code = "const a = req.query.id;\nlet { b, c: d, e = 1 } = request.body;\nvar f = other.query;\nconst g = req.headers;"
    df = spark.createDataFrame([(code,)], "content string").select(fi.js_tainted(F.col("content")).alias("t"))
    assert set(df.first().t) == {"a", "b", "d", "g"}
