"""Labelled code of twelve categories, on which the detectors are rated.

A document row gets the case ``doc_id % len(CASES)`` with its own names, so the
cases grow with the table.  ``#`` stands for the number of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import constant_table
from .derived import spread, table

#: (category, extension, expected rule or none for safe code, code)
CASES = [
    ("SQL Injection", "js", "SG-002", 'const rows# = await pool.query("SELECT name FROM staff# WHERE code = " + req.query.code);'),
    ("SQL Injection", "js", "SG-002", "const rows# = await pool.query(`UPDATE staff# SET seen = 1 WHERE code = ${req.body.code}`);"),
    ("SQL Injection", "js", "SG-002", "const text# = `\n  DELETE FROM staff#\n  WHERE code = ${code#}\n`;\nawait pool.query(text#);"),
    ("SQL Injection", "js", "SG-002", "await pool.query(req.query.statement#);"),
    ("SQL Injection", "py", "SG-002", 'cur.execute(f"SELECT * FROM staff# WHERE code = {code#}")'),
    ("SQL Injection", "py", "SG-002", 'text# = "DELETE FROM staff# WHERE code = " + code#\ncur.execute(text#)'),
    ("SQL Injection", "js", None, "const rows# = await pool.query('SELECT name FROM staff# WHERE code = $1', [req.query.code]);"),
    ("SQL Injection", "js", None, 'await pool.query("SELECT count(1) FROM staff#");'),
    ("SQL Injection", "py", None, 'cur.execute("SELECT * FROM staff# WHERE code = %s", (code#,))'),
    ("XSS", "js", "SG-003", "box#.innerHTML = location.hash;"),
    ("XSS", "js", "SG-003", "document.write(reply#.text);"),
    ("XSS", "js", "SG-003", "const name# = req.query.name;\nres.send(`<h2>${name#}</h2>`);"),
    ("XSS", "js", None, "box#.textContent = location.hash;"),
    ("XSS", "js", None, "const clean# = DOMPurify.sanitize(raw#);\nbox#.innerHTML = clean#;"),
    ("XSS", "js", None, 'box#.innerHTML = "<hr>";'),
    ("Command Injection", "js", "SG-022", "child.exec(`tar -x ${req.query.file#}`);"),
    ("Command Injection", "js", "SG-022", 'execSync("cat logs/" + req.params.day#);'),
    ("Command Injection", "py", "SG-022", 'name# = input("name")\nos.system("id " + name#)'),
    ("Command Injection", "js", None, 'execFile("tar", ["-x", file#], done);'),
    ("Command Injection", "js", None, 'execSync("date -u");'),
    ("Command Injection", "py", None, 'subprocess.run(["id", name#])'),
    ("Hardcoded Secrets", "js", "SG-001", 'const apiKey = "k9Qz47LmT0xB3vW8rD2sH#";'),
    ("Hardcoded Secrets", "py", "SG-001", 'password = "correct-horse-#"'),
    ("Hardcoded Secrets", "js", None, "const apiKey = process.env.API_KEY_#;"),
    ("Hardcoded Secrets", "py", None, 'password = os.environ["PASS_#"]'),
    ("Eval Injection", "js", "SG-023", "const sum# = eval(req.body.formula);"),
    ("Eval Injection", "js", "SG-009", 'const run# = new Function("a", wrap(req.body.code));'),
    ("Eval Injection", "py", "SG-023", 'eval(request.args["f#"])'),
    ("Eval Injection", "js", None, "const sum# = JSON.parse(text#);"),
    ("Eval Injection", "js", None, 'const run# = new Function(pick("a"), "return a + 1");'),
    ("SSRF", "js", "SG-012", "const got# = await fetch(req.query.address#);"),
    ("SSRF", "js", "SG-012", "const { link# } = req.body;\nconst got# = await fetch(link#);"),
    ("SSRF", "py", "SG-012", 'link# = request.args["link"]\nrequests.get(link#)'),
    ("SSRF", "js", None, 'const got# = await fetch("https://status.example/v#");'),
    ("SSRF", "py", None, 'requests.get("https://status.example/v#")'),
    ("Path Traversal", "js", "SG-021", "fs.readFile(req.params.file#, done);"),
    ("Path Traversal", "js", "SG-021", "const at# = path.join(base, req.params.file#);"),
    ("Path Traversal", "py", "SG-021", 'file# = request.args["file"]\nopen(file#)'),
    ("Path Traversal", "js", None, 'fs.readFile("settings#.json", done);'),
    ("Path Traversal", "py", None, 'open("settings#.txt")'),
    ("Prototype Pollution", "js", "SG-010", "for (const key in from#) {\n  if (deep) {\n    note(key);\n  }\n  to#[key] = from#[key];\n}"),
    ("Prototype Pollution", "js", "SG-010", "const all# = Object.assign(blank(1), req.body);"),
    ("Prototype Pollution", "js", None, "for (const key in from#) {\n  if (deep) {\n    note(key);\n  }\n  if (Object.hasOwn(from#, key)) {\n    to#[key] = from#[key];\n  }\n}"),
    ("Prototype Pollution", "js", None, "for (const key of Object.keys(from#)) {\n  to#[key] = from#[key];\n}"),
    ("Insecure Crypto", "js", "SG-004", 'const hash# = crypto.createHash("md5").update(pin#).digest("hex");'),
    ("Insecure Crypto", "py", "SG-004", "hash# = hashlib.sha1(pin#).hexdigest()"),
    ("Insecure Crypto", "js", None, 'const hash# = crypto.createHash("sha512").update(pin#).digest("hex");'),
    ("Insecure Crypto", "py", None, "hash# = hashlib.sha256(pin#).hexdigest()"),
    ("NoSQL Injection", "js", "SG-011", "const user# = await users.findOne(req.body);"),
    ("NoSQL Injection", "js", "SG-011", "await users#.deleteMany(req.query.filter);"),
    ("NoSQL Injection", "js", None, "const user# = await users.findOne({ code: String(req.body.code) });"),
    ("NoSQL Injection", "js", None, "await users.find({ age: { $gt: 17 + # } });"),
    ("Insecure Cookie", "js", "SG-013", 'res.cookie("sid#", seal(claims(user), key), { httpOnly: false, secure: true });'),
    ("Insecure Cookie", "js", "SG-013", 'res.cookie("sid#", token);'),
    ("Insecure Cookie", "js", None, 'res.cookie(\n  "sid#",\n  seal(claims(user), key),\n  { httpOnly: true, secure: true, maxAge: age(1) }\n);'),
    ("Insecure Cookie", "js", None, 'const sid# = req.cookie("sid#");'),
    ("Open Redirect", "js", "SG-006", "res.redirect(req.query.back#);"),
    ("Open Redirect", "js", "SG-006", "window.location.href = req.query.back#;"),
    ("Open Redirect", "js", None, 'res.redirect("/start/#");'),
    ("Open Redirect", "js", None, "res.redirect(allowed(req.query.back#));"),
]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (case_id, category, vulnerable, expected_rule, repo, path, content); the case id is the path."""
    pick = constant_table([dict(c=c, e=e, r=r, t=t) for c, e, r, t in CASES], "array<struct<c string, e string, r string, t string>>")
    doc = F.col("doc_id")
    found = spread(table(spark, sf_dir, "documents").select("doc_id")).withColumn("s", F.element_at(pick, (doc % len(CASES) + 1).cast("int")))
    path = F.concat(F.lit("case"), doc.cast("string"), F.lit("."), F.col("s.e"))
    return found.select(
        path.alias("case_id"), F.col("s.c").alias("category"), F.col("s.r").isNotNull().alias("vulnerable"), F.col("s.r").alias("expected_rule"),
        F.lit("cases").alias("repo"), path.alias("path"), F.replace(F.col("s.t"), F.lit("#"), doc.cast("string")).alias("content"),
    )
