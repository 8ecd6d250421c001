from codeassay.operators import evaluate as ev
from codeassay.plans.scan import scan

#: Own cases: category, code, vulnerable, expected rule.
CASES = [
    ("SQL Injection", "const rows = await pool.query(`SELECT name FROM staff WHERE code = ${req.query.code}`);", True, "SG-002"),
    ("SQL Injection", "const rows = await pool.query('SELECT name FROM staff WHERE code = $1', [req.query.code]);", False, None),
    ("Eval Injection", "const total = eval(req.body.formula);", True, "SG-023"),
    ("Eval Injection", "const total = JSON.parse(text);", False, None),
    ("Insecure Crypto", "const sum = crypto.createHash('md5').update(pin).digest('hex');", True, "SG-004"),
    ("Insecure Crypto", "const sum = crypto.createHash('sha256').update(pin).digest('hex');", False, None),
    ("Open Redirect", "reply.redirect(req.query.next);", True, "SG-006"),
    ("Open Redirect", "reply.redirect('/start');", False, None),
]


def test_own_cases(spark):
    rows = [(str(i), c, v, r, f"{i}.js", code) for i, (c, code, v, r) in enumerate(CASES)]
    cases = spark.createDataFrame(rows, "case_id string, category string, vulnerable boolean, expected_rule string, path string, content string")
    files = cases.selectExpr("category AS repo", "path", "content", "case_id")
    found = scan(files, mode="confirm", secrets=False, keep=("case_id",))
    counts = {r.category: (r.tp, r.fp, r.tn, r.fn) for r in ev.confusion(cases, found, ev.CATEGORY_RULES).collect()}
    assert set(counts) == {c for c, *_ in CASES} and all(x == (1, 0, 1, 0) for x in counts.values())


def test_counting_rules(spark):
    cases = spark.createDataFrame(
        [(1, "a", True, "X"), (2, "a", True, "X"), (3, "a", True, "X"), (4, "a", False, None), (5, "a", False, None), (6, "b", None, None), (7, "b", False, None)],
        "case_id int, category string, vulnerable boolean, expected_rule string",
    )
    findings = spark.createDataFrame([(1, "X"), (1, "Y"), (2, "Y"), (4, "Y"), (5, "Z"), (6, "Q"), (99, "X")], "case_id int, rule_id string")
    got = {r.category: tuple(r)[1:] for r in ev.confusion(cases, findings, {"a": ("Z",)}).collect()}
    assert got == {"a": (2, 1, 1, 1, 1), "b": (0, 1, 1, 0, 0)}
    rates = {r.category: (r.precision, r.recall, r.f1, r.fpr, r.accuracy) for r in ev.metrics(ev.confusion(cases, findings, {"a": ("Z",)})).collect()}
    assert rates == {"a": (66.7, 66.7, 66.7, 50.0, 60.0), "b": (0.0, 0.0, 0.0, 50.0, 50.0), None: (50.0, 66.7, 57.1, 50.0, 57.1)}
