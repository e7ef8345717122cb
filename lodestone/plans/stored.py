"""Queries over an index: documents come, change and go, and the tables show what is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.engine import Engine
from lodestone.plans.catalogue import _structured, questions, r6, table, widened
from lodestone.sources.scratch import saved, shared_folder, spread

#: What a changed document has before its text.
NOTE = "Revised note.\n\n"


def _index(spark, d):
    """An index of all documents: every tenth is ingested again with a note before it, and every tenth after those removed."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    named = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("name"), F.concat(F.lit("/data/"), "doc_id").alias("path"))
    engine = Engine.create(spark, shared_folder(spark, "index"))
    engine.ingest_plain(named.drop("n"))
    engine.ingest_plain(named.filter("n % 10 = 0").withColumn("text", F.concat(F.lit(NOTE), "text")).drop("n"), update=True)
    engine.index.remove(named.filter("n % 10 = 1").select("doc_id"))
    return engine


def index_chunks(spark, d):
    rows = _index(spark, d).index.chunks(with_concepts=True)
    return rows.select("chunk_id", "doc_id", "sequence", "chapter", F.array_join("concepts", ",").alias("concepts"), F.md5(F.encode("clean_text", "UTF-8")).alias("text_md5"))


def index_edges(spark, d):
    return _index(spark, d).index.table("edges").select("source", "target", "weight")


def index_documents(spark, d):
    """Each document's state, beside the index's number of chunks and their mean length in terms."""
    index = _index(spark, d).index
    whole = F.broadcast(index.statistics())  # one row
    return index.documents().join(whole).select("doc_id", "name", "path", "processed_chunks", "total_chunks", "state", "n", r6("avgdl").alias("avgdl"))


def index_topics(spark, d):
    """One topic in place of those of every third document, none for every third after those."""
    index = _index(spark, d).index
    third = F.col("doc_id").cast("long") % 3
    rows = index.chunks().filter(third == 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "chunk_id"))).alias("c"))
    whole = rows.select(F.concat("doc_id", F.lit("::whole")).alias("topic_id"), "doc_id", F.lit("whole").alias("title"), F.array().cast("array<double>").alias("centroid"), F.col("c.chunk_id").alias("chunk_ids"))
    index.replace_topics(whole, index.documents().filter(third < 2))
    return index.table("topics").select("topic_id", "doc_id", "title", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def index_retrieve(spark, d):
    """The graph profile; every other question asks within the document that its path names in part."""
    asked = questions(spark, d).withColumn("scope", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("/data/"), "query_id")))
    return _index(spark, d).retrieve(asked, "vector_graph").select("query_id", "chunk_id", r6("score").alias("score"), "rank")


def index_resume(spark, d):
    """Documents prepared in two goes, the first ones again with the second, and completed after each; with their links by kind."""
    named = saved(_structured(spark, d).withColumn("name", F.col("doc_id")).withColumn("path", F.col("doc_id")), "named")
    engine = Engine.create(spark, shared_folder(spark, "index"), Config(resume_chunks=20_000))
    for part in (named.filter("crc32(doc_id) % 2 = 0"), named):
        engine.prepare(part)
        engine.resume_all()
    kinds = {"members": "section_member", "neighbours": "adjacent", "references": "explicit_reference"}
    counts = engine.index.complete("links").groupBy("doc_id").agg(*(F.count(F.when(F.col("kind") == kind, 1)).alias(name) for name, kind in kinds.items()))
    return engine.index.documents().join(counts, "doc_id", "left").select("doc_id", "processed_chunks", "total_chunks", "state", *kinds)


QUERIES = {q.__name__: widened(q) for q in (index_chunks, index_edges, index_documents, index_topics, index_retrieve, index_resume)}
