"""Brackets against a plain reading of generated texts, calls and loops on samples, cost on long files."""

import random
import time

import pytest

from codeassay.functions.brackets import Brackets
from codeassay.operators.structure import file_facts
from codeassay.plans.scan import scan


def calls(text):
    return {n: [(c["name"], c["args"]) for c in f["calls"]] for n, f in enumerate(file_facts(text)) if f and f["calls"]}


def loops(text):
    return [n for n, f in enumerate(file_facts(text)) if f and f["loop"]]


def generated(rng, depth=0):
    """Code whose brackets are known: pieces without brackets, or with brackets that do not count, between counted ones."""
    quiet = ["a", " b ", ",", "'('", '"]"', "`}`", "// (\n", "/* [ { */", "\n", "= /[(]/ ", "'\\''", '"\\")"', "c / d", "; "]
    out = []
    for _ in range(rng.randrange(1, 5)):
        out.append((rng.choice(quiet), None))
        if depth < 4 and rng.random() < 0.6:
            kind = rng.choice(("()", "[]", "{}"))
            out += [(kind[0], "open"), *generated(rng, depth + 1), (kind[1], "close")]
        elif depth < 4 and rng.random() < 0.2:
            out += [("`t $ { ( \\` $", None), ("{", "open"), *generated(rng, depth + 1), ("}", "close"), (" ] `", None)]
    return out


def test_generated_texts():
    rng = random.Random(11)
    for _ in range(400):
        expected, stack, at, text = {}, [], 0, []
        for piece, what in generated(rng):
            if what == "open":
                stack.append(at)
            elif what == "close":
                expected[stack.pop()] = at
            text.append(piece)
            at += len(piece)
        found = Brackets("".join(text))
        assert found.close == expected and len(found.code) == len(found.text), "".join(text)
        assert [x.count("\n") for x in (found.code, found.text)] == [found.text.count("\n")] * 2


def test_faulty_texts_end():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("()[]{}'\"`/\\$ \na.;,:?") for _ in range(60))
        found = Brackets(text)
        assert len(found.code) == len(text) and all(a < b for a, b in found.close.items())
        file_facts("for (const k in " + text + "x.cookie(" + text)


def test_calls():
    assert calls("res.cookie('s', jwt.sign(claims(user), key), { httpOnly: false });") == {0: [("res.cookie", ["'s'", "jwt.sign(claims(user), key)", "{ httpOnly: false }"])]}
    assert calls("res\n  .status(f(1))\n  .cookie(`a${g(')')}`, /[)]/,)") == {0: [("cookie", ["`a${g(')')}`", "/[)]/"])]}
    assert calls("x = a?.b!.json<T, U>(err)\ny[0].send(e)\nthis.send(e)\nfunction send(e) {}\nnew Function()") == {
        0: [("a.b.json", ["err"])], 1: [("?.send", ["e"])], 2: [("send", ["e"])], 4: [("Function", [])],
    }
    assert calls("// res.send(err)\n'res.send(err)'\n`res.send(err)`\n`${res.send(err)}`") == {3: [("res.send", ["err"])]}
    assert calls("prose that ends.\nres.send(err)\nres.send(err") == {1: [("res.send", ["err"])]}


def test_values_of_objects():
    fact = file_facts("res.json({ a: 1, 'b': { c: [err], d: err.stack, e }, ...err, f() { return err } }, x)")[0]["calls"][0]
    assert sorted(fact["values"]) == ["1", "[err]", "e", "err.stack", "x"]


@pytest.mark.parametrize(
    "text, lines",
    [
        ("for (const k in s) {\n t[k] = s[k];\n}\nx", [0, 1, 2]),
        ("for (const k in s) {\n if (a) {\n }\n if (Object.hasOwn(s, k)) {}\n}", []),
        ("for (const k in s) {\n if (a) {\n }\n // s.hasOwnProperty(k)\n}\nif (s.hasOwnProperty(k)) {}", [0, 1, 2, 3, 4]),
        ("for (k in s) if (s.hasOwnProperty(k)) t[k] = 1;\nfor (k in s) t[k] = 1;\nfor (k of s) t[k] = 1;\nfor (let i = 0; i < n; i++) {}", [1]),
        ("for (const k in s) {\n for (const j in r) {\n  if (r.hasOwnProperty(j)) {}\n }\n}", []),
        ("for (const k in s) {\n for (const j in r) {\n }\n}\nif (r.hasOwnProperty(j)) {}", [0, 1, 2, 3]),
        ("for (const k in s) {\n if (this.hasOwnProperty(k)) {}\n}", [0, 1, 2]),
        ("for (const k in s) {\n if (Object.prototype.hasOwnProperty.call(s, k)) {}\n}", []),
    ],
)
def test_loops(text, lines):
    assert loops(text) == lines


@pytest.mark.parametrize("text", ["res.cookie('s', sign(claims(u), k), { secure: true });\n", "for (const k in s) {\n  f(g(k));\n}\n", ".json(e)", "json(", "for (k in s) {"])
def test_cost_follows_the_length(text):
    def seconds(n):
        start = time.perf_counter()
        file_facts("a" + text * n + ")" * n)
        return time.perf_counter() - start

    seconds(100)
    small = min(seconds(1000) for _ in range(3))
    assert seconds(10_000) < 40 * small + 0.5


def test_decisions(spark, files):
    corpus = files(
        ("nested.js", "res.cookie('s', jwt.sign(claims(user), key), { httpOnly: false, secure: false });\nres.cookie('t', f(g(1)), { httpOnly: true, secure: true });"),
        ("own.js", "for (const k in src) {\n  if (a) {\n    b();\n  }\n  if (Object.hasOwn(src, k)) { merge[k] = src[k]; }\n}"),
        ("bare.js", "for (const k in src) {\n  if (a) {\n    b();\n  }\n  Object.assign(t, src[k]);\n}"),
        ("late.js", "\n".join(f"res.cookie('s{i}', t, {{ httpOnly: {'true' if i % 2 else 'false'}, secure: true }});" for i in range(300))),
        ("make.js", "const f = new Function(g('a'), 'return 1');\nconst h = new Function('a', g('b'));"),
        ("none.py", "x = res.cookie('s', t)"),
    )
    found = scan(corpus, detectors=(6, 9, 10, 13, 16), declarative=False, secrets=False, dedup=False, mode="confirm")
    at = sorted((r.file_path, r.rule_id, r.line) for r in found.collect())
    late = sorted(("late.js", "SG-013", i + 1) for i in range(0, 300, 2))
    assert at == sorted([("nested.js", "SG-013", 1), ("bare.js", "SG-010", 1), ("bare.js", "SG-010", 5), ("make.js", "SG-009", 2), *late])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
