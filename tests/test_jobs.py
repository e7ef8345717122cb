"""The jobs: runs over growing input, replays, reruns, and what they leave behind."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import document_index, queries, retrieval_report, settings

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string"


def put(spark, folder, *rows, schema=KIND):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def index(spark, tmp_path, name="out", **options):
    return document_index.run(spark, str(tmp_path / "documents"), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"), options)


def shown(spark, tmp_path, table="chunks", name="out"):
    return document_index.current(spark, str(tmp_path / name), table, "bigint")


def test_index_takes_only_what_is_new(spark, tmp_path):
    folder = tmp_path / "documents"
    put(spark, folder, (1, "one two two", "en"), (2, "drei", "de"), (3, None, None), (None, "lost", "en"), (2, "drei", "de"))
    first = index(spark, tmp_path)
    assert (first["batches"], first["read"], first["without_id"], first["documents"], first["chunks"], first["postings"]) == (1, 5, 1, 3, 2, 3)
    assert index(spark, tmp_path)["read"] == 0
    put(spark, folder, (2, "drei", "de"), (4, "four", "en"))
    again = index(spark, tmp_path)
    assert (again["read"], again["documents"], again["chunks"]) == (2, 1, 1)
    assert sorted((r.doc_id, r.lang, r.clean_text) for r in shown(spark, tmp_path).collect()) == [(1, "en", "one two two"), (2, "de", "drei"), (4, "en", "four")]
    assert sorted((r.term, r.chunk_id, r.tf, r.dl) for r in shown(spark, tmp_path, "postings").collect()) == [("drei", "2::chunk_000000", 1, 1), ("four", "4::chunk_000000", 1, 1), ("one", "1::chunk_000000", 1, 3), ("two", "1::chunk_000000", 2, 3)]
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "out/chunks/batch=0/lang=*"))) == ["lang=de", "lang=en"]


def test_changed_documents_are_replaced(spark, tmp_path):
    folder = tmp_path / "documents"
    put(spark, folder, (1, "old words", "en"), (2, "goes away", "en"), (5, "b twice", "en"), (5, "a twice", "en"))
    index(spark, tmp_path)
    one = {r.doc_id: r.clean_text for r in shown(spark, tmp_path).collect()}
    assert one.keys() == {1, 2, 5} and one[5] in ("a twice", "b twice")
    put(spark, folder, (1, "new words entirely", "fr"), (2, "", "en"))
    index(spark, tmp_path)
    assert {r.doc_id: (r.lang, r.clean_text) for r in shown(spark, tmp_path).collect()} == {1: ("fr", "new words entirely"), 5: ("en", one[5])}
    assert "old" not in {r.term for r in shown(spark, tmp_path, "postings").collect()}


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    put(spark, tmp_path / "documents", *((i, f"text {i} " * 300, "en") for i in range(20)))
    index(spark, tmp_path)
    want = sorted(map(tuple, document_index.table(spark, str(tmp_path / "out"), "chunks", "bigint").collect()))
    for kept in glob.glob(str(tmp_path / "out-checkpoint/commits/*0*")) + glob.glob(str(tmp_path / "out-checkpoint/commits/.*0*")):
        os.remove(kept)  # as if the driver had died after the writes, before the commit
    assert index(spark, tmp_path)["documents"] == 20
    assert sorted(map(tuple, document_index.table(spark, str(tmp_path / "out"), "chunks", "bigint").collect())) == want


def test_settings_of_the_session_are_restored(spark, tmp_path):
    put(spark, tmp_path / "documents", (1, "x", "en"))
    name = next(iter(document_index.WHILE_RUNNING))
    before = spark.conf.get(name)
    index(spark, tmp_path)
    assert spark.conf.get(name) == before


def test_many_small_batches_and_no_lang(spark, tmp_path):
    for i in range(3):
        put(spark, tmp_path / "documents", (i, f"text {i}"), schema="doc_id long, text string")
    assert index(spark, tmp_path, max_files_per_trigger=1)["batches"] == 3
    assert {(r.doc_id, r.lang) for r in shown(spark, tmp_path).collect()} == {(0, None), (1, None), (2, None)}


def report(spark, tmp_path, **options):
    return retrieval_report.run(spark, str(tmp_path / "d"), str(tmp_path / "b"), str(tmp_path / "report"), options)


def test_report_by_hand_and_again(spark, tmp_path):
    put(spark, tmp_path / "d", (1, "a rare passage stands here", "en"), (2, "other words, more words", "en"), (3, "a rare passage stands here, too", "en"), (4, None, "en"), (None, "a rare passage", "en"))
    put(spark, tmp_path / "b", (2, "a rare passage"), (3, "nothing like it"), (5, None), (None, "a"), schema="item_id long, text string")
    seen = []
    for _ in range(2):
        counts = report(spark, tmp_path)
        assert (counts["documents"], counts["questions"], counts["metrics"]) == (3, 3, 3)
        seen.append({name: sorted(map(str, spark.read.parquet(str(tmp_path / "report" / name)).collect())) for name in ("rankings", "metrics", "summary")})
    assert seen[0] == seen[1]
    got = {r.query_id: r for r in spark.read.parquet(str(tmp_path / "report/metrics")).collect()}
    assert (got[2].split, got[2].relevant_documents, got[2].recall, got[2].mrr, got[2].ndcg) == ("test", 2, 1.0, 1.0, 1.0)
    assert (got[3].split, got[3].relevant_documents, got[3].recall) == ("dev", 0, None) and got[5].retrieved_documents == 0
    summary = {r.split: (r.questions, r.judged) for r in spark.read.parquet(str(tmp_path / "report/summary")).collect()}
    assert summary == {"test": (1, 1), "dev": (2, 0)}


def test_report_of_empty_tables(spark, tmp_path):
    put(spark, tmp_path / "d", schema=KIND)
    put(spark, tmp_path / "b", schema="item_id long, text string")
    assert report(spark, tmp_path) == {"documents": 0, "questions": 0, "chunks": 0, "rankings": 0, "metrics": 0, "summary": 0}


def test_settings_files(spark, tmp_path):
    for job in (document_index, retrieval_report):
        assert settings.load(spark, settings.beside(job.__file__), job.DEFAULTS) == job.DEFAULTS
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"cut": 5}, indent=1))
    assert settings.load(spark, str(path), retrieval_report.DEFAULTS)["cut"] == 5
    for bad in ({"other": 1}, {"cut": "5"}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            settings.load(spark, str(path), retrieval_report.DEFAULTS)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_jobs_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, DATA), con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_growing_copies_of_the_table(spark, tmp_path):
    """Two runs, each over more of the real table, come to what one run over all of it does."""
    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    for part in (0, 1):
        docs.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(str(tmp_path / "documents"))
        assert index(spark, tmp_path)["documents"] == docs.filter(F.col("doc_id") % 2 == part).count()
    document_index.run(spark, f"{DATA}/documents.parquet", str(tmp_path / "whole"), str(tmp_path / "whole-checkpoint"))
    columns = ["doc_id", "chunk_id", "clean_text", "lang"]
    assert sorted(map(tuple, shown(spark, tmp_path).select(*columns).collect())) == sorted(map(tuple, shown(spark, tmp_path, name="whole").select(*columns).collect()))
