"""Dependency extraction from manifests and lock files.

Every format is an array expression over the file's text, so all formats run
in one projection over the manifest slice of the corpus.  Lock files are cut
into blocks by the positions of their header lines; the blocks partition the
file, so the work is linear in its size.  Only the first lock-file version,
whose entries nest to any depth, is walked by an Arrow function.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import base_name, js_trim, lines_of
from .corpus import is_manifest

DEP = "struct<name:string,version:string,ecosystem:string,line:int,dev:boolean,license:string,declared_range:string>"
NONE = f"array<{DEP}>"
NULL = "cast(null as string)"


def _bare(raw: Column) -> Column:
    """A version without range operators."""
    return js_trim(F.regexp_replace(raw, r"^[\^~>=<]+", ""))


def _is_version(v: Column) -> Column:
    return v.rlike(r"^\d+\.\d+")


def clean_version(raw: Column) -> Column:
    """Strip range operators; NULL unless ``digits.digits`` follows."""
    v = _bare(raw)
    return F.when(_is_version(v), v)


def _dep(name, version, ecosystem, line, dev=None, license=None, declared=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        version.alias("version"),
        F.lit(ecosystem).alias("ecosystem"),
        line.cast("int").alias("line"),
        (F.lit(False) if dev is None else dev).alias("dev"),
        (null if license is None else license).alias("license"),
        (null if declared is None else declared).alias("declared_range"),
    )


def _text_only(json_value: Column) -> Column:
    """A JSON member read as text counts only if it was a string."""
    return F.when(~json_value.rlike(r"^\s*[\[{]"), json_value)


# ------------------------------------------------------------ JSON manifests
PACKAGE_JSON = "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, license STRING"


def _first_line(num: Column, text: Column, start: Column) -> Column:
    found = F.filter(num, lambda x: (x["n"] >= start) & F.contains(x["t"], text))
    return F.coalesce(F.get(found, F.lit(0))["n"], start)


SECTIONS = ("dependencies", "devDependencies")


def _section_lines(num: Column) -> Column:
    """The lines where the sections of a package.json begin."""
    return F.array(*[_first_line(num, F.lit(f'"{field}"'), F.lit(1)) for field in SECTIONS])


def package_json(doc: Column, starts: Column, num: Column) -> Column:
    """``doc`` (the parsed text) and ``starts`` must be columns: every entry looks at them."""

    def section(i: int, dev: bool) -> Column:
        at = F.get(starts, F.lit(i))
        entries = F.transform(
            F.map_entries(doc[SECTIONS[i]]),
            lambda e: F.struct(e["key"].alias("k"), F.concat(F.lit('"'), e["key"], F.lit('"')).alias("q"), e["value"].alias("raw"), _bare(e["value"]).alias("v")),
        )
        return F.transform(
            F.filter(entries, lambda e: _is_version(e["v"])),
            lambda e: _dep(
                e["k"], e["v"], "npm", _first_line(num, e["q"], at),
                F.lit(dev), _text_only(doc["license"]), F.when(e["raw"] != e["v"], e["raw"]),
            ),
        )

    none = F.array().cast(NONE)
    return F.concat(F.coalesce(section(0, False), none), F.coalesce(section(1, True), none))


LOCK_ENTRY = (
    "STRUCT<version STRING, dev BOOLEAN, license STRING, dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>>"
)
LOCK = f"packages MAP<STRING,{LOCK_ENTRY}>, dependencies STRING"


def _lock_packages(packages: Column) -> Column:
    """(name, entry) of the ``packages`` section, without the root entry."""
    entries = F.map_entries(packages)
    named = F.transform(
        F.filter(entries, lambda e: (e["key"] != "") & (F.coalesce(e["value"]["version"], F.lit("")) != "")),
        lambda e: F.struct(F.regexp_replace(e["key"], "^.*node_modules/", "").alias("name"), e["value"].alias("info")),
    )
    return F.filter(named, lambda e: e["name"] != "")


def package_locks(files: DataFrame) -> DataFrame:
    return files.filter(base_name(F.col("path")) == "package-lock.json").select("repo", "path", "content")


ENTRY = "struct<ord:array<int>,name:string,version:string,dev:boolean,license:string,children:array<struct<child:string,range:string>>>"


def _as_text(value) -> str | None:
    """A member that is asked for as text: other values as they are written."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(_plain(value), separators=(",", ":"), ensure_ascii=False)


def _plain(value):
    if isinstance(value, _Members):
        return {k: _plain(v) for k, v in value}
    return [_plain(v) for v in value] if isinstance(value, list) else value


class _Members(list):
    """Members of an object in order, repeated names included."""

    def last(self, name: str):
        return next((v for k, v in reversed(self) if k == name), None)


def nested_entries(text: str) -> list[dict]:
    """All entries of a first-version lock file; ``ord`` is the way of positions that leads to one.

    A text that is no object, or has a ``packages`` section, has none.  An
    entry without a version is left out with what it holds.
    """
    try:
        doc = json.loads(text, object_pairs_hook=_Members)
    except ValueError:
        return []
    if not isinstance(doc, _Members) or isinstance(doc.last("packages"), _Members) or not isinstance(doc.last("dependencies"), _Members):
        return []
    out, todo = [], [((), doc.last("dependencies"))]
    while todo:
        way, members = todo.pop()
        for i, (name, entry) in enumerate(members):
            version = _as_text(entry.last("version")) if isinstance(entry, _Members) else None
            if not version:
                continue
            needs, inner = entry.last("requires"), entry.last("dependencies")
            children = [{"child": k, "range": _as_text(v)} for k, v in needs] if isinstance(needs, _Members) else []
            out.append({"ord": [*way, i], "name": name, "version": version, "dev": entry.last("dev") is True, "license": None, "children": children})
            if isinstance(inner, _Members):
                todo.append(((*way, i), inner))
    return out


def _nested(contents: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([
        ("ord", pa.list_(pa.int32())), ("name", pa.string()), ("version", pa.string()), ("dev", pa.bool_()), ("license", pa.string()),
        ("children", pa.list_(pa.struct([("child", pa.string()), ("range", pa.string())]))),
    ]))
    return pa.array([None if x is None else nested_entries(x) for x in contents.to_pylist()], kind)


def lock_entries(locks: DataFrame) -> DataFrame:
    """All entries of package lock files of any version, in one pass whatever their depth.

    Columns: repo, path, ord (position, or way of positions where entries nest),
    name, version, dev, license, children (name to range).
    """
    asked = lambda m: F.transform(
        F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")), lambda x: F.struct(x["key"].alias("child"), x["value"].alias("range"))
    )
    flat = F.transform(
        _lock_packages(F.col("_d.packages")),
        lambda e, i: F.struct(
            F.array(i).alias("ord"), e["name"].alias("name"), e["info"]["version"].alias("version"), F.coalesce(e["info"]["dev"], F.lit(False)).alias("dev"),
            _text_only(e["info"]["license"]).alias("license"),
            F.concat(
                asked(e["info"]["dependencies"]),
                F.filter(asked(e["info"]["devDependencies"]), lambda x: ~F.coalesce(F.map_contains_key(e["info"]["dependencies"], x["child"]), F.lit(False))),
            ).alias("children"),
        ),
    )
    nested = F.arrow_udf(_nested, f"array<{ENTRY}>").asNondeterministic()
    read = locks.select("repo", "path", "content", F.from_json("content", LOCK).alias("_d"))
    first = F.col("_d.packages").isNull() & F.col("_d.dependencies").isNotNull()
    none = F.array().cast(f"array<{ENTRY}>")
    return read.select("repo", "path", "_d", nested(F.when(first, F.col("content"))).alias("_nested")).select(
        "repo", "path", F.inline(F.concat(F.coalesce(flat, none), F.coalesce("_nested", none)))
    )


# ------------------------------------------------------------ line manifests
def requirements_txt(num: Column) -> Column:
    pattern = r"^([a-zA-Z0-9_][a-zA-Z0-9._-]*)(?:\[.*?\])?\s*==\s*([^\s;#,]+)"
    rows = F.filter(num, lambda x: x["s"].rlike(pattern) & ~x["s"].rlike("^[#-]"))
    return F.transform(
        rows,
        lambda x: _dep(F.lower(F.regexp_extract(x["s"], pattern, 1)), F.regexp_extract(x["s"], pattern, 2), "PyPI", x["n"]),
    )


def _blocks(num: Column, heads: Column, build, with_first: bool = False) -> Column:
    """Apply ``build(header line number, header text, body)`` to every block.

    ``heads`` holds the header line numbers; both inputs must be columns, not
    expressions, so they are computed once per file.
    """
    size = F.size(num)

    def block(h: Column, j: Column) -> Column:
        end = F.coalesce(F.get(heads, j + 1), size + 1)
        body = F.slice(num, h + 1, F.greatest(end - h - 1, F.lit(0)))
        return build(h, F.get(num, h - 1)["t"], body)

    return F.transform(heads, block)


def _last_group(body: Column, pattern: str, text: str = "t") -> Column:
    """The group of the last line that matches; patterns match no empty group."""
    groups = F.transform(body, lambda x: F.regexp_extract(x[text], pattern, 1))
    return F.try_element_at(F.filter(groups, lambda g: g != ""), F.lit(-1))


def _sectioned(num: Column, heads: Column, wanted: dict, build) -> Column:
    """Entries of the sections named in ``wanted`` (header text -> extra)."""

    def section(h, header, body):
        head = js_trim(header)
        out = F.array().cast(NONE)
        for text, extra in wanted.items():
            out = F.when(head == text, build(body, extra)).otherwise(out)
        return out

    return F.flatten(_blocks(num, heads, section))


def pipfile(num: Column, heads: Column) -> Column:
    pattern = r'^([a-zA-Z0-9_][a-zA-Z0-9._-]*)\s*=\s*"==([^"]+)"'

    def build(body, dev):
        rows = F.filter(body, lambda x: x["s"].rlike(pattern))
        return F.transform(
            rows,
            lambda x: _dep(F.lower(F.regexp_extract(x["s"], pattern, 1)), F.regexp_extract(x["s"], pattern, 2), "PyPI", x["n"], F.lit(dev)),
        )

    return _sectioned(num, heads, {"[packages]": False, "[dev-packages]": True}, build)


def cargo_toml(num: Column, heads: Column) -> Column:
    simple = r'^([a-zA-Z0-9_][a-zA-Z0-9_-]*)\s*=\s*"([^"]+)"'
    table = r'^([a-zA-Z0-9_][a-zA-Z0-9_-]*)\s*=\s*\{.*?version\s*=\s*"([^"]+)"'

    def build(body, dev):
        def one(x):
            t = x["s"]
            pick = lambda g: F.when(t.rlike(simple), F.regexp_extract(t, simple, g)).when(t.rlike(table), F.regexp_extract(t, table, g))
            return F.struct(x["n"].alias("n"), pick(1).alias("name"), _bare(pick(2)).alias("v"))

        rows = F.filter(F.transform(body, one), lambda r: r["name"].isNotNull() & _is_version(r["v"]))
        return F.transform(rows, lambda r: _dep(r["name"], r["v"], "crates.io", r["n"], F.lit(dev)))

    sections = {"[dependencies]": False, "[dev-dependencies]": True, "[build-dependencies]": True}
    return _sectioned(num, heads, sections, build)


def go_mod(num: Column, heads: Column) -> Column:
    """Single-line and block requirements; ``heads`` are the lines that open or close a block."""
    single, inner = r"^require\s+(\S+)\s+(v\S+)", r"^(\S+)\s+(v\S+)"
    entry = lambda pattern: lambda x: _dep(F.regexp_extract(x["s"], pattern, 1), F.regexp_extract(x["s"], pattern, 2), "Go", x["n"])
    singles = F.transform(F.filter(num, lambda x: x["s"].rlike(single) & ~F.contains(x["t"], F.lit("("))), entry(single))

    def build(body, _):
        rows = F.filter(body, lambda x: x["s"].rlike(inner) & ~x["s"].startswith("//") & ~x["s"].rlike(r"^require [^(]*$"))
        return F.transform(rows, entry(inner))

    blocks = _sectioned(num, heads, {"require (": None}, build)
    return F.array_sort(F.concat(singles, blocks), lambda a, b: a["line"] - b["line"])


def go_sum(num: Column) -> Column:
    pattern = r"^(\S+)\s+(v[^\s/]+)\s+h1:"
    rows = F.filter(num, lambda x: x["s"].rlike(pattern) & ~F.contains(x["t"], F.lit("/go.mod ")))
    return F.transform(rows, lambda x: _dep(F.regexp_extract(x["s"], pattern, 1), F.regexp_extract(x["s"], pattern, 2), "Go", x["n"]))


def yarn_lock(num: Column, heads: Column, version: str) -> Column:
    header = r'^"?(@?[^@"]+)@'

    def build(h, text, body):
        return F.struct(h.alias("n"), F.regexp_extract(text, header, 1).alias("name"), _last_group(body, version).alias("v"))

    rows = F.filter(_blocks(num, heads, build), lambda r: (r["name"] != "") & r["v"].isNotNull())
    return F.transform(rows, lambda r: _dep(r["name"], r["v"], "npm", r["n"]))


def pnpm_lock(num: Column, heads: Column) -> Column:
    entry = r"^\s{2,4}/?(@?[^@\s(][^@\s]*)@(\d+\.\d+[^:\s(]*)(?:\(.*?\))?:"

    def build(body, _):
        return F.transform(
            F.filter(body, lambda x: x["t"].rlike(entry)),
            lambda x: _dep(F.regexp_extract(x["t"], entry, 1), F.regexp_extract(x["t"], entry, 2), "npm", x["n"]),
        )

    return _sectioned(num, heads, {"packages:": None, "snapshots:": None}, build)


def cargo_lock(num: Column, heads: Column) -> Column:
    def build(h, _, body):
        return F.struct(
            h.alias("n"),
            _last_group(body, r'^name\s*=\s*"([^"]+)"', "s").alias("name"),
            _last_group(body, r'^version\s*=\s*"([^"]+)"', "s").alias("v"),
        )

    rows = F.filter(_blocks(num, heads, build), lambda r: r["name"].isNotNull() & r["v"].isNotNull())
    return F.transform(rows, lambda r: _dep(r["name"], r["v"], "crates.io", r["n"]))


def _heads(kind: Column, num: Column) -> Column:
    """Header line numbers by format."""
    top = lambda x: (x["t"] != "") & ~x["t"].startswith(" ")
    pick = lambda test: F.transform(F.filter(num, test), lambda x: x["n"])
    return (
        F.when(kind.isin("Pipfile", "Cargo.toml"), pick(lambda x: x["s"].startswith("[")))
        .when(kind == "Cargo.lock", F.concat(F.array(F.lit(0)), pick(lambda x: x["s"] == "[[package]]")))
        .when(kind == "go.mod", pick(lambda x: x["s"].isin("require (", ")")))
        .when(kind == "yarn.lock", pick(lambda x: top(x) & ~x["t"].startswith("#") & (x["t"] != "__metadata:")))
        .when(kind == "pnpm-lock.yaml", pick(top))
        .otherwise(F.array().cast("array<int>"))
    )


#: formats whose lines are read without the white space around them
TRIMMED = ("requirements.txt", "Pipfile", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock")


def _lines(kind: Column, content: Column) -> Column:
    """Numbered lines as they are (``t``) and, for ``TRIMMED``, without white space around them (``s``): trimmed once, read often."""
    return F.transform(
        lines_of(content), lambda t, i: F.struct((i + 1).alias("n"), t.alias("t"), F.when(kind.isin(*TRIMMED), js_trim(t)).alias("s"))
    )


#: formats that report a package once per file
ONCE = ("yarn.lock", "pnpm-lock.yaml", "go.sum")


def parse_manifests(files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(repo, path, content) -> one row per declared dependency.

    ``entries`` takes the result of ``lock_entries`` when it is at hand.

    Columns: repo, name, version, ecosystem, source, line, dev, license,
    declared_range, ord (position within the file).
    """
    m = files.filter(is_manifest(F.col("path")) & (base_name(F.col("path")) != "package-lock.json")).select(
        "repo", "path", "content", base_name(F.col("path")).alias("_kind")
    )
    num, heads, kind, content = F.col("_num"), F.col("_heads"), F.col("_kind"), F.col("content")
    m = m.withColumn("_num", _lines(kind, content))
    # what the entries of a file share is found once per file, not inside the loops over them
    is_json = kind == "package.json"
    m = m.withColumns({"_heads": _heads(kind, num), "_doc": F.when(is_json, F.from_json(content, PACKAGE_JSON)), "_starts": F.when(is_json, _section_lines(num))})
    berry = content.contains("__metadata:")
    deps = (
        F.when(is_json, package_json(F.col("_doc"), F.col("_starts"), num))
        .when((kind == "yarn.lock") & berry, yarn_lock(num, heads, r'^\s+version:\s*"?([^"\s]+)"?'))
        .when(kind == "yarn.lock", yarn_lock(num, heads, r'^\s+version\s+"([^"]+)"'))
        .when(kind == "pnpm-lock.yaml", pnpm_lock(num, heads))
        .when(kind == "requirements.txt", requirements_txt(num))
        .when(kind == "Pipfile", pipfile(num, heads))
        .when(kind == "go.mod", go_mod(num, heads))
        .when(kind == "go.sum", go_sum(num))
        .when(kind == "Cargo.toml", cargo_toml(num, heads))
        .when(kind == "Cargo.lock", cargo_lock(num, heads))
    )
    rows = m.select("repo", "path", "_kind", F.posexplode(deps).alias("_i", "d"))
    every = rows.filter(~F.col("_kind").isin(*ONCE)).select("repo", F.col("path").alias("source"), F.array("_i").alias("ord"), "d.*")
    # first occurrence per file for the formats that report once; keys are fine-grained, so nothing gathers.
    # Position and line in one number keep the aggregate a hash aggregate; the other columns follow from the path
    null = F.lit(None).cast("string")
    first = F.shiftleft(F.col("_i").cast("long"), 32).bitwiseOR(F.col("d.line").cast("long"))
    once = rows.filter(F.col("_kind").isin(*ONCE)).groupBy("repo", "path", "d.name", "d.version", "d.ecosystem").agg(F.min(first).alias("_f")).select(
        "repo", F.col("path").alias("source"), F.array(F.shiftright("_f", 32).cast("int")).alias("ord"), "name", "version", "ecosystem",
        F.col("_f").bitwiseAND(0xFFFFFFFF).cast("int").alias("line"), F.lit(False).alias("dev"), null.alias("license"), null.alias("declared_range"),
    )
    out = every.unionByName(once)
    locked = entries if entries is not None else lock_entries(package_locks(files))
    return out.unionByName(
        locked.select(
            "repo", F.col("path").alias("source"), "ord", "name", "version", F.lit("npm").alias("ecosystem"), F.lit(1).alias("line"), "dev", "license",
            F.lit(None).cast("string").alias("declared_range"),
        )
    )


def dedup_dependencies(deps: DataFrame, scan: str = "repo", order=("source", "ord"), cap: int | None = None) -> DataFrame:
    """First occurrence per package and version of a scan, in file order.

    The aggregate pre-reduces before its shuffle and its key contains the
    package, so a scan that holds a third of all rows is still spread out.
    """
    rest = [c for c in deps.columns if c not in (scan, "ecosystem", "name", "version", *order)]
    first = deps.groupBy(scan, "ecosystem", "name", "version").agg(
        F.min(F.struct(*order, *rest)).alias("_f")
    ).select(scan, "ecosystem", "name", "version", *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]])
    if cap is None:
        return first
    w = Window.partitionBy(scan).orderBy(*order, "name", "version", "ecosystem")
    return first.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")
