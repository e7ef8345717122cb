"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import catalogue, stored
from lodestone.plans.sql import ORACLES
from lodestone.streaming.ingest import start_ingest

DATA = "/root/testdata/sf0.001"
QUERIES = catalogue.QUERIES | stored.QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    want = tables.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(plain, got.select(*names).collect())) == sorted(map(plain, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_replayed_batches_add_nothing(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "x " * 900), ("b", "y")], "doc_id string, text string").write.parquet(str(source))
    stream = lambda: spark.readStream.schema("doc_id string, text string").parquet(str(source))
    for checkpoint in ("one", "one", "two"):  # a restart, and a replay from nothing
        start_ingest(stream(), str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_streams_of_two_checkpoints_keep_both(spark, tmp_path):
    for name in ("one", "two"):
        source = tmp_path / name
        spark.createDataFrame([(name, "x")], "doc_id string, text string").write.parquet(str(source))
        start_ingest(spark.readStream.schema("doc_id string, text string").parquet(str(source)), str(tmp_path / "out"), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one", "two"}
