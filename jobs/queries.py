"""The jobs as registered queries, with their SQL: each runs twice into a new folder and returns the whole output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import document_index, retrieval_report
from lodestone.plans import sql
from lodestone.sources.scratch import shared_folder


def job1_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current chunk with how many terms the postings have for it."""
    root, documents = shared_folder(spark, "job1"), f"{sf_dir}/documents.parquet"
    for _ in range(2):
        document_index.run(spark, documents, f"{root}/index", f"{root}/checkpoint")
    key = spark.read.parquet(documents).schema["doc_id"].dataType.simpleString()
    terms = document_index.current(spark, f"{root}/index", "postings", key).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))
    rows = document_index.current(spark, f"{root}/index", "chunks", key).join(terms, "chunk_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("lang", "doc_id", F.col("sequence").cast("long").alias("sequence"), "chunk_id", "clean_text", F.md5(F.encode("context_text", "UTF-8")).alias("context_md5"), count("n").alias("distinct_terms"), count("tf").alias("terms"))


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every question."""
    out = shared_folder(spark, "job2")
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    found = spark.read.parquet(f"{out}/metrics")
    return found.select("split", "query_id", "relevant_documents", "retrieved_documents", *(F.round(c, 6).alias(c) for c in retrieval_report.SCORES))


QUERIES = {"job1_document_index": job1_document_index, "job2_retrieval_report": job2_retrieval_report}

ORACLES = {
    "job1_document_index": f"""{sql._with(sql._chunks(), sql._terms('chunks', 'chunk_id', 'clean_text', 'postings'))},
        c AS (SELECT *, coalesce(right(lag(clean_text) OVER (PARTITION BY doc_id ORDER BY sequence), 100) || chr(10), '') || clean_text AS context_text FROM chunks),
        n AS (SELECT chunk_id, count(*) AS distinct_terms, CAST(sum(tf) AS BIGINT) AS terms FROM postings GROUP BY chunk_id)
        SELECT lang, doc_id, sequence, chunk_id, clean_text, md5(context_text) AS context_md5, coalesce(distinct_terms, 0) AS distinct_terms, coalesce(terms, 0) AS terms
        FROM c JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) LEFT JOIN n USING (chunk_id)""",
    "job2_retrieval_report": f"""{sql.JUDGED}, {sql._metrics(10)},
        r AS (SELECT query_id, count(*) AS n FROM relevance GROUP BY query_id),
        t AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM rankings GROUP BY query_id)
        SELECT CASE WHEN q.query_id % 2 = 0 THEN 'test' ELSE 'dev' END AS split, q.query_id, coalesce(r.n, 0) AS relevant_documents, coalesce(t.n, 0) AS retrieved_documents,
               round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg
        FROM questions q LEFT JOIN r USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN m10 USING (query_id)""",
}
