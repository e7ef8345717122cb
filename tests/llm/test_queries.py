"""Registered queries against their SQL, and the pipeline against plain stages."""

import glob
import hashlib
import os

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm.oracles import ORACLES
from lodestone.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    want = tables.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_every_document_is_answered(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op1_byte_bpe", "op2_toxicity", "op3_line_dedup", "op4_token_counts", "op7_secret_scan", "op10_simhash"):
        assert QUERIES[name](spark, DATA).count() == n


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        n.append(docs.count())
    assert n[0] > n[1] >= n[2] > n[3] >= n[4] > 0.5 * n[0]
    run = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()} == {k: r.decoded_sha256 for k, r in run.items()}
    assert all(r.n_tokens == len(r.ids) for r in run.values())
