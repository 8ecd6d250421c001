"""Manifest files derived from lineitem: one file per order, one entry per item.

An order has a handful of items, so the grouping that builds a file is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .derived import table

FORMATS = (
    "package.json", "package-lock.json", "package-lock.json", "yarn.lock", "yarn.lock", "pnpm-lock.yaml",
    "requirements.txt", "Pipfile", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock",
)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, items): the items of an order with their position."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus").alias("x")
    )
    # few bytes that take long to work on: with a number given, adaptive plans do not put them into a few large tasks
    spread = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return spread.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("x")).alias("xs"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content)."""
    k = F.col("k")
    s = lambda c: c.cast("string")

    def entry(x: Column, i: Column) -> Column:
        pk, sk = x["l_partkey"], x["l_suppkey"]
        plain = F.concat(F.lit("p"), s(pk), F.lit("x"), s(i))
        return F.struct(
            i.alias("i"),
            plain.alias("p"),
            F.concat(F.when(pk % 7 == 0, F.lit("@s/")).otherwise(F.lit("")), plain).alias("n"),
            F.concat(s(pk % 9), F.lit("."), s(pk % 5), F.lit("."), s(sk % 10)).alias("v"),
            (x["l_linestatus"] == "F").alias("dev"),
            (pk % 4).alias("m"),
        )

    def each(build, sep="\n", where=None) -> Column:
        src = F.col("es") if where is None else F.filter(F.col("es"), where)
        return F.array_join(F.transform(src, build), sep)

    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    raw = lambda e: F.when(e["m"] == 0, c("^", e["v"])).when(e["m"] == 1, e["v"]).when(e["m"] == 2, F.lit("*")).otherwise(c(">=", e["v"]))
    devs, mains = (lambda e: e["dev"]), (lambda e: ~e["dev"])
    pair = lambda e: c('    "', e["n"], '": "', raw(e), '"')
    license_line = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit('  "license": "MIT",\n'))
    package_json = c(
        '{\n  "name": "o', s(k), '",\n', license_line, '  "dependencies": {\n', each(pair, ",\n", mains),
        '\n  },\n  "devDependencies": {\n', each(pair, ",\n", devs), "\n  }\n", F.when(k % 24 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    flag = lambda e: F.when(e["dev"], F.lit(', "dev": true')).otherwise(F.lit(""))
    lock2 = c(
        '{"lockfileVersion": 2, "packages": {"": {"version": "0.0.1"}',
        each(
            lambda e: c(
                ', "node_modules/', F.when(e["i"] % 2 == 1, F.lit("a/node_modules/")).otherwise(F.lit("")), e["n"], '": {',
                F.when(e["m"] == 2, F.lit('"resolved": "x"')).otherwise(c('"version": "', e["v"], '"')), flag(e),
                ', "license": "MIT", "dependencies": {"', F.concat(F.lit("p"), s(e["i"] + 1)), '": "^1.0.0"',
                F.when(e["i"] > 0, c(', "', F.get(F.col("es"), e["i"] - 1)["n"], '": "~2.0.0"')).otherwise(F.lit("")), "}}",
            ),
            "",
        ),
        "}}",
    )
    lock1 = c(
        '{"lockfileVersion": 1, "dependencies": {',
        each(
            lambda e: c(
                '"', e["n"], '": {"version": "', e["v"], '"', flag(e), ', "requires": {"c', s(e["i"]), '": "^9.0.0"}',
                F.when(
                    e["m"] == 0,
                    c(', "dependencies": {"c', s(e["i"]), '": {"version": "9.9.9", "dependencies": {"d', s(e["i"]), '": {"version": "1.1.1"}}}}'),
                ).otherwise(F.lit("")),
                "}",
            ),
            ", ",
        ),
        "}}",
    )
    quoted = lambda e, text: F.when(e["n"].startswith("@"), c('"', text, '"')).otherwise(text)
    yarn1 = c(
        "# yarn lockfile v1\n\n",
        each(lambda e: c(quoted(e, c(e["n"], "@^1.0.0, ", e["n"], "@~1.0")), ':\n  version "', e["v"], '"\n  resolved "x"\n\n'), ""),
    )
    yarn2 = c(
        "__metadata:\n  version: 6\n\n",
        each(lambda e: c('"', e["n"], '@npm:^1.0.0":\n  version: ', e["v"], '\n  resolution: "', e["n"], "@npm:", e["v"], '"\n\n'), ""),
    )
    slash = F.when(k % 24 < 12, F.lit("/")).otherwise(F.lit(""))
    pnpm = c(
        "lockfileVersion: '6.0'\n\nimporters:\n  app@1.0.0:\n\npackages:\n",
        each(lambda e: c("  ", slash, e["n"], "@", e["v"], F.when(e["m"] == 3, F.lit("(react@18.0.0)")).otherwise(F.lit("")), ":\n    dev: false\n"), ""),
        "snapshots:\n",
        each(lambda e: c("  ", e["n"], "@", e["v"], ": {}\n"), ""),
    )
    requirements = c(
        "# pinned\n-r base.txt\n",
        each(
            lambda e: F.when(e["m"] == 0, c("P", e["p"], "==", e["v"]))
            .when(e["m"] == 1, c(e["p"], "[extra] == ", e["v"], " ; python_version > '3'"))
            .when(e["m"] == 2, c(e["p"], ">=", e["v"]))
            .otherwise(c("  ", e["p"], "==", e["v"], "  # note"))
        ),
    )
    toml = lambda e: F.when(e["m"] == 2, c(e["p"], ' = "*"')).otherwise(c("P", e["p"], ' = "==', e["v"], '"'))
    pipfile = c(
        "[[source]]\nurl = \"x\"\n\n[packages]\n", each(toml, "\n", mains), "\n[dev-packages]\n", each(toml, "\n", devs), "\n[requires]\npython = \"==3.9\"",
    )
    go_entry = lambda e: c("g.io/", e["p"], " v", e["v"])
    go_mod = c(
        "module m\n\ngo 1.21\n", each(lambda e: c("require ", go_entry(e)), "\n", mains), "\nrequire (\n\t// pinned v1\n",
        each(lambda e: c("\t", go_entry(e), " // indirect"), "\n", devs), "\n)\n",
    )
    go_sum = each(lambda e: c(go_entry(e), " h1:aa=\n", "g.io/", e["p"], " v", e["v"], "/go.mod h1:bb=\n", go_entry(e), " h1:aa="), "\n")
    crate = lambda e: F.when(e["m"] == 0, c(e["p"], ' = "^', e["v"], '"')).when(e["m"] == 1, c(e["p"], ' = { version = "', e["v"], '", features = ["a"] }')).when(
        e["m"] == 2, c(e["p"], ' = "1"')
    ).otherwise(c(e["p"], ' = { path = "x", version = "', e["v"], '" }'))
    cargo_toml = c(
        '[package]\nname = "m"\nversion = "0.1.0"\n\n[dependencies]\n', each(crate, "\n", mains), "\n[dev-dependencies]\n",
        each(crate, "\n", devs), "\n[profile]\nopt = \"3.0\"",
    )
    cargo_lock = c("version = 3\n\n", each(lambda e: c('[[package]]\nname = "', e["p"], '"\nversion = "', e["v"], '"\n'), "\n"))
    bodies = [package_json, lock2, lock1, yarn1, yarn2, pnpm, requirements, pipfile, go_mod, go_sum, cargo_toml, cargo_lock]
    kind = k % 12
    content, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (body, file_name) in enumerate(zip(bodies, FORMATS)):
        content = F.when(kind == i, body).otherwise(content)
        name = F.when(kind == i, F.lit(file_name)).otherwise(name)
    base = items(spark, sf_dir).select("k", F.transform("xs", entry).alias("es"))
    return base.select(
        F.concat(F.lit("r"), s(k)).alias("repo"), F.concat(F.lit("app/"), name).alias("path"), content.alias("content"), "es"
    ).drop("es")


def items_sql() -> str:
    """One row per entry: what a correct parser must report."""
    return """it AS (
  SELECT k, i, p, CASE WHEN pk % 7 = 0 THEN '@s/' ELSE '' END || p AS n, v, dev, m,
    count(*) FILTER (WHERE NOT dev) OVER (PARTITION BY k) AS n_main, count(*) OVER (PARTITION BY k) AS n_all,
    row_number() OVER (PARTITION BY k, dev ORDER BY i) AS j, k % 12 AS kind
  FROM (SELECT l_orderkey AS k, l_partkey AS pk, i, 'p' || l_partkey || 'x' || i AS p,
      (l_partkey % 9) || '.' || (l_partkey % 5) || '.' || (l_suppkey % 10) AS v, l_linestatus = 'F' AS dev, l_partkey % 4 AS m
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) - 1 AS i FROM lineitem)))"""


def expected_sql(kind: int | None = None) -> str:
    """Expected dependencies by format, computed from the items alone."""
    npm = "SELECT 'r' || k AS repo, 'app/{f}' AS source, {n} AS name, {v} AS version, '{e}' AS ecosystem, CAST({l} AS INT) AS line, {d} AS dev, {lic} AS license, {r} AS declared_range FROM it WHERE kind = {k}{w}"
    nul = "CAST(NULL AS VARCHAR)"

    def row(k, f, n, v, e, l, d="false", lic=nul, r=nul, w=""):
        return npm.format(k=k, f=f, n=n, v=v, e=e, l=l, d=d, lic=lic, r=r, w=w)

    # sections keep an empty line when they have no entries
    main_lines = "greatest(n_main, 1)"
    lic_line = "CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END"
    after = lambda base: f"CASE WHEN dev THEN {base} + {main_lines} + 1 + j ELSE {base} + j END"
    parts = {
        0: [row(0, "package.json", "n", "v", "npm",
                f"CASE WHEN dev THEN 3 + {lic_line} + {main_lines} + 2 + j ELSE 3 + {lic_line} + j END", "dev",
                "CASE WHEN k % 5 <> 0 THEN 'MIT' END", "CASE m WHEN 0 THEN '^' || v WHEN 3 THEN '>=' || v END", " AND m <> 2 AND k % 24 <> 0")],
        1: [row(1, "package-lock.json", "n", "v", "npm", "1", "dev", "'MIT'", nul, " AND m <> 2")],
        2: [row(2, "package-lock.json", "n", "v", "npm", "1", "dev"),
            row(2, "package-lock.json", "'c' || i", "'9.9.9'", "npm", "1", w=" AND m = 0"),
            row(2, "package-lock.json", "'d' || i", "'1.1.1'", "npm", "1", w=" AND m = 0")],
        3: [row(3, "yarn.lock", "n", "v", "npm", "3 + i * 4")],
        4: [row(4, "yarn.lock", "n", "v", "npm", "4 + i * 4")],
        5: [row(5, "pnpm-lock.yaml", "n", "v", "npm", "7 + i * 2")],
        6: [row(6, "requirements.txt", "CASE WHEN m = 0 THEN lower('P' || p) ELSE p END", "v", "PyPI", "3 + i", w=" AND m <> 2")],
        7: [row(7, "Pipfile", "lower('P' || p)", "v", "PyPI", after("4"), "dev", w=" AND m <> 2")],
        8: [row(8, "go.mod", "'g.io/' || p", "'v' || v", "Go", f"CASE WHEN dev THEN 3 + {main_lines} + 2 + j ELSE 3 + j END")],
        9: [row(9, "go.sum", "'g.io/' || p", "'v' || v", "Go", "1 + i * 3")],
        10: [row(10, "Cargo.toml", "p", "v", "crates.io", after("5"), "dev", w=" AND m <> 2")],
        11: [row(11, "Cargo.lock", "p", "v", "crates.io", "3 + i * 4")],
    }
    chosen = parts[kind] if kind is not None else [x for p in parts.values() for x in p]
    return f"WITH {items_sql()} " + " UNION ALL ".join(chosen)
