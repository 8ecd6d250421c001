"""Registered queries against their SQL on the smallest tables; the pipeline against its parts."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from codeassay.llm.queries import ORACLE, QUERIES
from odd_rows import odd_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents benchmark pages conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == theirs


def test_all_are_registered():
    names = contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    docs = odd_documents(spark).drop("row_key")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if n < 4:
            assert out.columns == docs.columns
            # Each stage gets the odd rows too, not only what the one before leaves.
        out.write.parquet(str(tmp_path / name))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_takes_effect(spark):
    out = contract.queries()["pipeline"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    kept = set(out.doc_id)
    assert 0 < len(kept) < len(docs) and kept <= set(docs.index)
    hit = QUERIES["op8_winnowing"](spark, SF).toPandas().set_index("doc_id")
    assert not kept & set(hit.index[hit.contaminated & (hit.n_words > 400)])
    judged = QUERIES["op3_compression_bands"](spark, SF).toPandas().set_index("doc_id")
    assert kept <= set(judged.index[judged.kept])
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 2048 and own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
