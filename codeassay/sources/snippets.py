"""Code samples that turn the prose tables into a source-code corpus.

A document row gets the sample number ``doc_id % len(samples)``, so the amount
of code grows with the table.  A sample is (extension, head, token length,
upper case?, tail); the token comes from the document id.
"""

from __future__ import annotations

from ..catalog.secrets import secret_rules

_JS = [
    # 001, 007
    'const api_key = "a1b2c3d4e5f6g7h8i9j0k1l2";\nconst password = process.env.PASSWORD;',
    'const password = "SuperLong123!@#";\nconst apiKey = "test_key_1234567890";',
    'const t = jwt.sign(user, "my-signing-key", { expiresIn: "1h" });\nconst u = jwt.sign(user, process.env.JWT_KEY);',
    # 002
    'app.get("/u", (req, res) => {\n  const id = req.query.id;\n  db.query("SELECT * FROM users WHERE id = " + id);\n});',
    'const n = parseInt(req.query.n);\nif (isNaN(n)) return;\ndb.query("DELETE FROM t WHERE n = " + n);',
    "const r = await db.query(`SELECT * FROM t WHERE name = '${name}'`);",
    'const q = mysql.escape(name);\ndb.execute("SELECT 1 FROM t WHERE a = " + q);\ndb.raw("UPDATE t SET a = " + mysql.escape(b));',
    "const sql = `\n  SELECT *\n  FROM t\n  WHERE id = ${id}\n`;\ndb.query(sql);",
    'db.query("SELECT * FROM t WHERE id = ?", [id]);',
    # 003
    'el.innerHTML = value;\nel.innerHTML = "<b>fixed</b>";\nel.outerHTML = value;',
    "const safe = DOMPurify.sanitize(raw);\nel.innerHTML = safe;\nel.innerHTML = escapeHtml(raw);",
    "document.write(payload);\nres.send(`<p>${name}</p>`);\nres.send('<h1>' + name + '</h1>');",
    "<div dangerouslySetInnerHTML={{ __html: html }} />",
    # 004
    'const h = crypto.createHash("md5").update(password).digest("hex");\nconst r = Math.random();',
    'const checksum = crypto.createHash("md5").update(buffer).digest("hex");\n\n\nconst s = crypto.createHash("sha1");',
    'const c = crypto.createCipheriv("des-ede", key, iv);\nconst ok = crypto.createHash("sha256");',
    # 005, 021
    "fs.readFile(req.query.path, cb);\nfs.readFileSync(`/data/${req.params.file}`);",
    'const f = req.body.file;\nfs.writeFileSync("/up/" + f, data);\nconst p = path.join(base, req.params.name);',
    'const base = path.resolve("/srv");\nconst p = path.resolve(base, req.query.p);\nif (!p.startsWith(base)) throw new Error("no");\nfs.createReadStream(`${p}`);',
    # 006
    'res.redirect(req.query.url);\nlocation.href = request.query.next;\nres.redirect("/home");',
    # 008, 009
    'jwt.verify(t, k, { algorithm: "none" });\nconst o = { algorithms: ["none"] };',
    'const f = new Function("a", body);\nconst g = new Function("return 1");\nnew Function(code)();',
    # 010
    "for (const k in src) {\n  target[k] = src[k];\n}",
    "for (const k in src) {\n  if (src.hasOwnProperty(k)) {\n    target[k] = src[k];\n  }\n}",
    "Object.assign({}, req.body);\nObject.assign({}, defaults);\n_.merge(config, req.body);\nobj.__proto__ = evil;",
    # 011
    'users.find(req.body);\nusers.findOne({ age: { $gt: 3 } });\nusers.find({ active: true });',
    # 012
    'const r = await fetch(req.body.url);\naxios.get(req.query.target);\nfetch("https://api.example.com/v1");',
    "const { url } = req.query;\nconst enc = encodeURIComponent(url);\nfetch(url);\nfetch(`https://h/${url}`);\nfetch(API);",
    # 013, 014
    'res.cookie("sid", t, { httpOnly: true, secure: true });\nres.cookie("sid", t);\nres.cookie("sid", t, { httpOnly: false });',
    'res.cookie("sid", t, {\n  httpOnly: true,\n  secure: true,\n  maxAge: 3600\n});',
    'res.setHeader("Access-Control-Allow-Origin", "*");\napp.use(cors());\nconst o = { origin: "*" };\nres.setHeader("Access-Control-Allow-Origin", "https://a.b");',
    # 015, 016, 017, 018, 019
    "const re = /(a+)+$/;\nconst r2 = new RegExp('(a|b)*');\nconst r3 = /^ok$/;",
    "res.status(500).json({ error: err.stack });\nres.send(err);\nconsole.log(error);\nres.json({ error: 'x' });",
    'https.request({ rejectUnauthorized: false });\nprocess.env.NODE_TLS_REJECT_UNAUTHORIZED = "0";\nconst o = { rejectUnauthorized: true };',
    "if (token === req.body.token) ok();\nif (user.password != input) fail();\nif (a === b) ok();",
    "function f() {\n  debugger;\n  return 1;\n}\n  debugger",
    # 020, 022, 023
    "serialize.unserialize(data);\nconst o = unserialize($x);\nnew ObjectInputStream(s).readObject();",
    'exec(req.body.cmd);\nexec("ls " + req.query.dir);\nexecSync(`cat ${req.params.f}`);\nexec("ls -la");',
    'const arg = shellEscape(req.body.a);\nexec(`git log ${arg}`);\nexecFile("ls", ["-la", dir]);\nspawn(`x`, [a]);',
    'eval(expr);\neval("1 + 1");\nconst v = JSON.parse(s);\neval(code + "()");',
    # declarative rules 030-069, suppressed and not
    '<a href="javascript:void(0)">x</a>',
    '<a target="_blank" href={u}>x</a>\n<p>\n</p>\n<i/>\n<a target="_blank" rel="noopener noreferrer">y</a>',
    "UNSAFE_componentWillMount() {}",
    "useEffect(() => { setInterval(tick, 1000) }, []);\nnext();\nuseEffect(() => { socket.subscribe(x);\n  return () => {};\n});",
    "const k = process.env.NEXT_PUBLIC_SECRET_KEY;",
    "export async function GET(req) {\n  const rows = load();\n  const n = 1;\n  const m = 2;\n}\nexport function POST(req) {\n  const session = check();\n}",
    "redirect(searchParams.next);\nNextResponse.redirect(request.url);",
    "'use server'; const a = { password: p, n: 1 };",
    "const b = new Buffer(10);\nconst s = http.createServer(app);\n\n\n\nconst l = http.createServer(app); // localhost",
    "fs.chmod('/tmp/x', 0o777);\nfs.writeFileSync('x', d, { mode: 0777 });",
    "const re = new RegExp(req.query.q);\nspawn('sh', a, { shell: true });\np.catch();",
    'const app = express();\napp.use(logger());\napp.get("/x", h);\n// app.use(x)',
    'const app = express();\napp.use(helmet());\napp.get("/x", h);',
    "app.use(express.json());\napp.use(express.static('public'));\napp.use(express.static('pub', { dotfiles: 'deny' }));",
    "app.use(session({ name: 'a', secret: 'b' }));\nlet a = 1;\nlet b = 2;\nlet c = 3;\napp.use(session({ secret: s, cookie: { secure: true } }));",
    "res.status(500).send(err.stack);\nres.json({ s: error.stack });",
    "window.addEventListener('message', (e) => {\n  run(e.data);\n  a();\n  b();\n});\nwindow.addEventListener('message', (e) => {\n  if (e.origin !== o) return;\n});",
    "localStorage.setItem('token', t);\nlocalStorage.setItem('theme', jwt);\nlocalStorage.setItem('theme', t2);",
    "window.open(url);\nlet z = 0;\nlet y = 0;\nlet x = 0;\nwindow.open(url, '_blank', 'noopener');",
    "document.domain = 'a.b';\nwindow.location = req.query.u;\nlocation.href = userUrl;",
    "if (password.length > 4) ok();\nif (Password.length >= 12) ok();",
    "<form method=\"POST\">\n<p>a</p>\n<p>b</p>\n<p>c</p>\n<form method='post'><input name=\"csrf\"/></form>",
    "if (signature === req.headers.sig) ok();\nif (apiKey == req.query.k) ok();\nfoo();\nbar();\nbaz();\nif (token === body.t && crypto.timingSafeEqual(a, b)) ok();",
    "const o = { debug: true };\na();\nb();\nc();\nconst p = { debug: process.env.NODE_ENV !== 'production' };\nDEBUG = \"on\"",
    "console.error('failed', err);\na();\nb();\nc();\nconsole.log(err.message);",
    "const host = '10.0.0.12';\nconst h2 = \"192.168.1.4\";\nx();\ny();\nz();\nconst h3 = '172.20.1.1'; // test host",
    "const o = { rejectUnauthorized: 0 };\nconst d = JSON.parse(req.body);\na();\nb();\nc();\ntry { JSON.parse(input); } catch (e) {}",
    "const up = multer({ dest: 'x' });\na();\nb();\nc();\nconst u2 = multer({ fileFilter: ff });",
    "db.run(`INSERT INTO t VALUES (${a})`);\nModel.create({ ...req.body });\nModel.update({ id, ...data });",
    "console.log('login', password);\na();\nb();\nc();\nconsole.info('token', mask(token));",
    "const h = `<b>${user.name}</b>`;\nconst n = req.body.name || 'x';\nq();\nw();\ne();\nconst s = req.body.text && req.body.text.slice(0, 9);",
    '<iframe src={ ${url} }></iframe>\na();\nb();\nc();\n<iframe src=${u} sandbox="x"></iframe>',
    "// eval(x)\n * fetch(y)\n// new Buffer(1)\néval(x); éeval(y);",
    "const q = db.query(`\n  SELECT *\n  FROM t WHERE id = ${id}`);\nconst k = 'sk_test_1';\nexec(cmd, req.body);",
    "import a from 'lodash';\nimport { b } from '@scope/pkg/sub';\nconst c = require('express');\nimport './local';\nconst d = await import('chalk/x');",
    # calls in calls, over lines, with brackets in texts and comments
    'res.cookie("s", jwt.sign(claims(user), key), { httpOnly: false, secure: false });\nres.cookie("t", seal(a, (b)), { httpOnly: true, secure: true, maxAge: age(1, 2) });',
    'res.cookie(\n  "sid", // it is (not a bracket\n  sign(user, "a)b"),\n  { secure: true }\n);\nres.cookie(name(), value, options);\nconst v = req.cookie("sid");\nres.cookie("x", y, { nested: { httpOnly: true, secure: true } });\nres.cookie(\n  "ok", seal([1, 2]), /* both ) set */\n  { secure: true,\n    httpOnly: true }\n);',
    "for (const k in src) {\n  if (deep) {\n    log(k);\n  }\n  if (Object.hasOwn(src, k)) {\n    target[k] = src[k];\n  }\n}\nfor (let i = 0; i < n; i++) { merge(a, b); }",
    "for (const k in src) {\n  if (deep) {\n    log(k);\n  }\n  Object.assign(target, src[k]);\n}\nif (src.hasOwnProperty(k)) done();\nfor (k in a) if (a.hasOwnProperty(k)) b[k] = a[k];\nfor (const k in a) b[k] = a[k];\nfor (const x in y) {\n  for (const k in a) {\n    if (this.hasOwnProperty(k)) merge(a, k);\n  }\n}",
    'Object.assign(make(1, two()), req.body);\nObject.assign({}, (x), wrap(req.body));\nconst m = deepmerge(a, f(b));\nmerged(a);\nvm.merge(a);\nObject.assign({}, req.query["a"], b);',
    'res.redirect(req.query.code, pick(req.query.url));\nres.redirect(req.query.code || code(302), req.query["url"]);\nconst g = new Function(build("a"), "return 1");\nconst f = new Function("a", build("x", ")"));\nnew Function();',
    "res.json({ error: fmt(err, 1), detail: { stack: err.stack } });\nres.json({ message: fmt(error) });\nres.send('failed (', err);\nres.status(400).json({ error });\nres.json({ ...error, message: x });",
]
_TS = [
    "interface User { name: string }\nconst x: number = eval(code);",
    "import { Pool } from 'pg';\nconst { id } = req.params;\npool.query(`UPDATE t SET a = ${id}`);",
    "export const h = async (req: Request) => { redirect(req.url); };\ndebugger;",
]
_PY = [
    'cursor.execute(f"SELECT * FROM t WHERE id = {x}")\ncursor.execute("SELECT * FROM t WHERE id = %s", (x,))',
    'cursor.execute("SELECT * FROM t WHERE a = \'%s\'" % a)\ncursor.execute("DELETE FROM t WHERE a = {}".format(a))\ncursor.execute("SELECT COUNT(*) FROM t")',
    'q = "SELECT * FROM t WHERE id = " + uid\ncursor.execute(q)\ncursor.execute(other)\nsafe = "SELECT 1"\ncursor.execute(safe)',
    'cursor.execute("SELECT * FROM t WHERE id = " + request.args["id"])',
    'name = request.args.get("n")\nreturn f"<h1>{name}</h1>"\nreturn f"<h1>{request.form}</h1>"',
    'clean = html.escape(raw)\nreturn f"<h1>{clean}</h1>"\nreturn "<p>%s</p>" % clean\nreturn "<p>{}</p>".format(other)',
    'resp = make_response(f"<b>{x}</b>")\nm = mark_safe(f"{x}")\nn = mark_safe("<b>{}</b>".format(x))',
    "h = hashlib.md5(password.encode())\netag = hashlib.sha1(body).hexdigest()\n\n\n\nz = 1",
    'url = request.args["u"]\nrequests.get(url)\nrequests.get("https://a.b/c")\nhttpx.post(target)',
    'u = input("url")\nv = urllib.parse.quote(u)\nrequests.get(v)\nurllib.request.urlopen(base + u)',
    'f = request.args["f"]\nopen(f)\nopen("fixed.txt")\nopen(f"/data/{x}")\nopen(other)',
    "n = int(request.args['n'])\nopen(n)\nm = n + 1\nopen(m, 'r')",
    "import os\nx = input()\ny = 'rm ' + x\nz = y\nos.system(z)\nos.system('ls')\nos.system(cmd)",
    'import shlex\ncmd = input()\nsafe = shlex.quote(cmd)\nos.system("echo " + safe)\nos.popen(safe)\nsubprocess.run(["ls", cmd])\nsubprocess.call(cmd, shell=True)',
    "b = a\na = sys.argv[1]\nc = a\nsubprocess.Popen(c)\nsubprocess.Popen(b)",
    "eval(request.data)\neval('1+1')\nexec(code)\nx = ast.literal_eval(s)",
    "data = pickle.loads(blob)\ncfg = yaml.load(f)\ncfg2 = yaml.load(f, Loader=yaml.SafeLoader)",
    "import flask\nfrom numpy.linalg import norm\nimport os.path, sys\nx == y",
    "password = 'hunter2hunter2'\napi_key = os.environ['API_KEY']\npattern = re.compile('/(x+)+/')",
    "from app import db\n\nclass Thing:\n    def run(self, q):\n        print(q)\n",
]
_OTHER = [
    (".md", "# notes\nplain text with eval(x) that is not scanned"),
    (".txt", "just prose"),
    (".JS", "eval(upper)"),
    (".mts", "const x: string = eval(y);"),
    (".js", "el.innerHTML = a;\r\n\r\nconst line = 'windows';\r\neval(b);\r"),
    ("", "import os\nprint('no extension')"),
]


def samples() -> list[tuple[str, str, int, bool, str]]:
    out = [(".js", s, 0, False, "") for s in _JS]
    out += [(".ts", s, 0, False, "") for s in _TS]
    out += [(".py", s, 0, False, "") for s in _PY]
    out += [(e, s, 0, False, "") for e, s in _OTHER]
    exts = (".js", ".ts", ".py")
    out += [(exts[i % 3], *r.sample) for i, r in enumerate(secret_rules())]
    return out
