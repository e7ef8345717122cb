"""Judges lexical retrieval over a table of documents: rankings, metrics and a summary, by split.

    python -m jobs.retrieval_report --documents PATH --benchmark PATH --out PATH [--settings FILE]

Every item of the benchmark is a question; a document that holds the item's
passage is relevant.  The best chunks by BM25 rank their documents.  Written,
each partitioned by split (test: ids that ``test_every`` divides, else dev):

    OUT/rankings/split=S    query_id, chunk_id, doc_id, bm25, lexical_rank
    OUT/metrics/split=S     query_id, relevant and retrieved documents, recall, mrr and ndcg (null where nothing is relevant)
    OUT/summary/split=S     the means over judged questions, and how many there are

A rerun replaces the partitions that it writes and gives the same rows.
Documents without an id or text, and items without an id, take no part; of
items with one id the greatest text counts.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings as given
from lodestone.operators.chunking import split_documents
from lodestone.operators.containment import holding
from lodestone.operators.evaluate import ranking_metrics
from lodestone.operators.lexical import asked_topk
from lodestone.sources.scratch import broadcast_if_small, saved, spread

DEFAULTS = {"chunk_size": 800, "recall_k": 40, "cut": 10, "test_every": 2, "judging_gram": 16}
SCORES = ("recall", "mrr", "ndcg")
log = logging.getLogger(__name__)


def run(spark: SparkSession, documents: str, benchmark: str, out: str, settings: dict | None = None) -> dict[str, int]:
    """Writes the report; how many rows were read and written."""
    use = DEFAULTS | (settings or {})
    docs = spread(spark.read.parquet(documents).select("doc_id", "text").filter("doc_id is not null and text is not null"))
    items = spark.read.parquet(benchmark).filter("item_id is not null").groupBy(F.col("item_id").alias("query_id")).agg(F.max("text").alias("question"))
    split = F.when(F.col("query_id") % use["test_every"] == 0, "test").otherwise("dev")
    asked = saved(items.withColumn("split", split), "asked")
    rows = saved(split_documents(docs, size=use["chunk_size"]).select("chunk_id", "doc_id", "clean_text"), "chunks")
    top = asked_topk(asked.select("query_id", "question"), rows, use["recall_k"])
    by_split = broadcast_if_small(asked.select("query_id", "split"))
    ranked = top.join(rows.select("chunk_id", "doc_id"), "chunk_id").join(by_split, "query_id")
    counts = {"documents": docs.count(), "questions": asked.count(), "chunks": rows.count()}
    log.info("read %s", counts)

    def written(df: DataFrame, name: str) -> DataFrame:
        path, order = f"{out}/{name}", df.columns
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)
        back = spark.read.schema(df.schema).parquet(path).select(*order)
        counts[name] = back.count()
        log.info("wrote %d rows to %s", counts[name], path)
        return back

    rankings = written(ranked.select("query_id", "chunk_id", "doc_id", "bm25", "lexical_rank", "split"), "rankings")
    held = holding(asked.select(F.col("question").alias("term")), docs, ["doc_id"], "text", use["judging_gram"])
    relevance = saved(held.join(broadcast_if_small(asked), F.col("term") == F.col("question")).select("query_id", "doc_id", F.lit(1).alias("grade")).distinct(), "relevance")
    scores = ranking_metrics(rankings.select("query_id", "doc_id", F.col("lexical_rank").alias("rank")), relevance, use["cut"])
    relevant = relevance.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant_documents"))
    retrieved = rankings.groupBy("query_id").agg(F.countDistinct("doc_id").alias("retrieved_documents"))
    found = asked.select("query_id", "split").join(relevant, "query_id", "left").join(retrieved, "query_id", "left").join(scores, "query_id", "left")
    whole = [F.coalesce(c, F.lit(0)).alias(c) for c in ("relevant_documents", "retrieved_documents")]
    metrics = written(found.select("query_id", *whole, *SCORES, "split"), "metrics")
    means = [F.avg(c).alias(c) for c in SCORES]
    written(metrics.groupBy("split").agg(F.count(F.lit(1)).alias("questions"), F.count("recall").alias("judged"), *means).select("questions", "judged", *SCORES, "split"), "summary")
    return counts


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "benchmark", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--settings", default=given.beside(__file__))
    asked = parser.parse_args(args)
    spark = given.session("retrieval report")
    try:
        run(spark, asked.documents, asked.benchmark, asked.out, given.load(spark, asked.settings, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
