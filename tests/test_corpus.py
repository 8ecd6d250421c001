import pytest

from codeassay.operators import corpus as co
from codeassay.sources import tree


def write(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


FILES = {
    "a/src/x.js": "one", "a/package.json": "{}", "a/node_modules/y/z.js": "no", "b/src/x.js": "two", "b/deep/er/m.PY": "three", "b/logo.png": "no", "top.ts": "four",
    "b/big.js": "x" * 5000, "node_modules/q.js": "no",
}


def test_repositories_and_paths(spark, tmp_path):
    write(tmp_path, FILES)
    found = {(r.repo, r.path): r.content for r in co.read_corpus(spark, str(tmp_path)).collect()}
    name = tmp_path.name
    assert set(found) == {("a", "a/src/x.js"), ("a", "a/package.json"), ("b", "b/src/x.js"), ("b", "b/deep/er/m.PY"), (name, "top.ts"), ("b", "b/big.js")}
    assert found["b", "b/src/x.js"] == "two"
    assert {r.repo for r in co.read_corpus(spark, f"file://{tmp_path}/", repo_depth=2).collect()} == {"a/src", "b/src", "b/deep", name}


def test_limits_only_when_asked(spark, tmp_path):
    write(tmp_path, FILES)
    paths = {r.path for r in co.read_corpus(spark, str(tmp_path), max_bytes=100, languages=["javascript"], manifests=False, repo="r").collect()}
    assert paths == {"a/src/x.js", "b/src/x.js"}
    (tmp_path / "none").mkdir()
    assert co.read_corpus(spark, str(tmp_path / "none")).count() == 0


def test_contents_of_ignored_paths_are_not_read(spark, tmp_path):
    write(tmp_path, FILES)
    for ignored in ("a/node_modules/y/huge.js", "b/huge.png"):
        with open(tmp_path / ignored, "wb") as f:
            f.truncate(3 << 30)  # no row can hold it
    assert co.read_corpus(spark, str(tmp_path)).count() == 6


NAMES = ["app/[locale]/page.tsx", "app/[...all]/{id}/x.js", "a b/c?d*.js", "pc%20t/a%5B.js", "s\\t/q.py", "_app/__init__.py", ".github/x.js", "é日/ü😀.ts", "r/a#b;c&d=e+.mjs", "x/__tests__/_y.JSX", "q'u\"o.js"]


def test_names_are_taken_as_they_are(spark, tmp_path):
    root = tmp_path / "ro[o]t {x}*?"
    write(root, {p: f"text of {p}" for p in NAMES})
    for at in (str(root), f"file:{root}", f"file://{root}/"):
        found = {r.path: r.content for r in co.read_corpus(spark, at, repo="r").collect()}
        assert found == {p: f"text of {p}" for p in NAMES}


def test_walk_in_rounds(spark, tmp_path):
    write(tmp_path, {f"{i % 7}/{i % 5}/{'d/' * (i % 9)}f{i}.js": "x" * i for i in range(300)})
    (tmp_path / "loop").symlink_to(tmp_path)
    every = {(str(p.relative_to(tmp_path)), p.stat().st_size) for p in tmp_path.rglob("*.js") if "loop" not in p.parts}
    assert {tuple(r) for r in tree.list_tree(spark, str(tmp_path), entries=3).collect()} == every == {tuple(r) for r in tree.list_tree(spark, str(tmp_path)).collect()}
    with pytest.raises(FileNotFoundError):
        tree.list_tree(spark, str(tmp_path / "missing"))


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.js").write_bytes(b"a\xffb")
    (tmp_path / "e.js").write_bytes(b"")
    assert {(r.path, r.content, r.size) for r in co.read_corpus(spark, str(tmp_path)).collect()} == {("x.js", "a\ufffdb", 3), ("e.js", "", 0)}


def test_changes_belong_to_a_repository(spark):
    files = spark.createDataFrame([("a", "src/x.js"), ("b", "src/x.js")], "repo string, path string")
    changed = files.filter("repo = 'a'")
    none = files.limit(0)
    assert [tuple(r) for r in co.restrict_to(files, co.changed_in_work_tree(changed, none, none)).collect()] == [("a", "src/x.js")]
