"""Registered queries against DuckDB on the smallest tables.

Set FULL_ORACLE=1 to compare all of them.
"""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
FAST = (
    "scan_deduplicated", "scan_all_findings", "language_detection", "ignore_filter", "multiline_sql_templates", "quick_triage_scan",
    "taint_py_sources", "manifest_all_formats", "dependency_dedup", "advisory_join", "license_findings", "dependency_edges", "reachability",
    "dependency_chains", "policy_evaluation", "severity_rollup", "finding_facets", "portfolio_score", "pull_request_report", "sarif_results",
    "sbom_components", "snippet_fingerprint", "accuracy_metrics", "quota_fixed_window_tight", "scan_lifecycle", "scan_confirmed", "corpus_from_files",
    "detector_010_prototype_pollution_confirmed", "detector_accuracy", "advisory_interval_index", "sca_failed_lookups", "sarif_every_scan",
    "policy_matches", "cache_entries_stream", "cache_upsert_table", "distinct_files_by_month",
)
ORACLE = contract.oracle_sql()
NAMES = list(ORACLE) if os.environ.get("FULL_ORACLE") else FAST


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((plain(tuple(r[i] for i in at)) for r in cur.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert contract.entry(spark).count() > 0
