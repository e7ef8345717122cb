"""Keeps an index of a growing folder of documents: chunks and term postings.

    python -m jobs.document_index --documents PATH --out PATH --checkpoint PATH [--settings FILE]

The folder's new files are read as a stream until none is left; the checkpoint
remembers which files, and which texts of which ids, were taken.  Every
micro-batch writes to partitions of its own number, so one that is replayed
after a failure writes the same again and adds nothing:

    OUT/documents/batch=N              doc_id, digest, n_chunks
    OUT/chunks/batch=N/lang=L          the chunks of new and changed documents
    OUT/postings/batch=N/bucket=B      term, chunk_id, doc_id, tf, dl; a term lies in one bucket

A document that comes again unchanged is passed over; one that comes with
another text is indexed anew, and ``current`` shows each document's latest
version only.  Of several texts of an id in one batch the one of the greatest
digest counts.  Rows without an id are left out and counted in the log; a null
text is an empty document, which has no chunks but replaces what was there.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings as given
from lodestone.operators.chunking import split_documents
from lodestone.operators.lexical import postings

DEFAULTS = {"chunk_size": 800, "term_buckets": 16, "max_files_per_trigger": 1000}
#: While the stream runs: the ids seen so far are kept on the executors' disks, not in their heaps, and no batch's count is forgotten.
WHILE_RUNNING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "1000000",
}
log = logging.getLogger(__name__)


def table(spark: SparkSession, out: str, name: str, key: str) -> DataFrame:
    """A table of the index; ``key`` is the type of doc_id."""
    columns = {
        "documents": f"doc_id {key}, digest string, n_chunks long, batch long",
        "chunks": f"doc_id {key}, sequence int, chunk_id string, clean_text string, context_text string, chapter string, batch long, lang string",
        "postings": f"term string, chunk_id string, doc_id {key}, tf long, dl int, batch long, bucket int",
    }
    return spark.read.schema(columns[name]).parquet(f"{out}/{name}")


def current(spark: SparkSession, out: str, name: str, key: str) -> DataFrame:
    """The rows of a table that belong to their document's latest version."""
    latest = table(spark, out, "documents", key).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return table(spark, out, name, key).join(latest, ["doc_id", "batch"])


def pattern(path: str) -> str:
    """A path as a pattern of its last part, which a file stream takes for a file and for a folder alike."""
    head, slash, tail = path.rstrip("/").rpartition("/")
    return f"{head}{slash}[{tail[0]}]{tail[1:]}"


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Takes all that is new in ``documents`` (doc_id, text and perhaps lang); what was read and written."""
    use = DEFAULTS | (settings or {})
    schema = spark.read.parquet(documents).schema
    key = schema["doc_id"].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in schema.names else F.lit(None).cast("string")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).option("maxFilesPerTrigger", use["max_files_per_trigger"])
    text = F.coalesce("text", F.lit(""))
    rows = source.parquet(pattern(documents)).select("doc_id", text.alias("text"), lang.alias("lang"), F.sha2(text, 256).alias("digest"))
    counts = dict.fromkeys(("batches", "read", "without_id", "documents", "chunks", "postings"), 0)

    def index(batch: DataFrame, number: int) -> None:
        batch.persist()  # read for chunks and for documents
        try:
            write_all(batch, number)
        finally:
            batch.unpersist()

    def write_all(batch: DataFrame, number: int) -> None:
        # One version an id; the struct's order makes the choice the same in every replay.
        new = batch.groupBy("doc_id").agg(F.max(F.struct("digest", "text", "lang")).alias("d")).select("doc_id", "d.*")
        write = lambda df, name, *by: df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{out}/{name}/batch={number}")
        own = lambda name: table(spark, out, name, key).filter(F.col("batch") == number)
        write(split_documents(new, size=use["chunk_size"], keep=("lang",)), "chunks", "lang")
        sizes = own("chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
        write(new.select("doc_id", "digest").join(sizes, "doc_id", "left").select("doc_id", "digest", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")), "documents")
        terms = postings(own("chunks"), keep=("doc_id",)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(use["term_buckets"])).cast("int"))
        write(terms.select("term", "chunk_id", "doc_id", "tf", "dl", "bucket"), "postings", "bucket")
        found = {name: own(name).count() for name in ("documents", "chunks", "postings")}
        for name, n in found.items():
            counts[name] += n
        counts["batches"] += 1
        log.info("batch %d: wrote %s to %s", number, found, out)

    before = {name: spark.conf.get(name, None) for name in WHILE_RUNNING}
    try:
        for name, value in WHILE_RUNNING.items():
            spark.conf.set(name, value)
        observed = rows.observe("taken", F.count(F.lit(1)).alias("read"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("without_id"))
        fresh = observed.filter("doc_id is not null").dropDuplicates(["doc_id", "digest"])
        query = fresh.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    for progress in query.recentProgress:
        taken = progress["observedMetrics"].get("taken")
        for name in ("read", "without_id") if taken else ():
            counts[name] += taken[name]
    log.info("read %d rows of %s, %d without an id; wrote %s", counts["read"], documents, counts["without_id"], counts)
    return counts


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--settings", default=given.beside(__file__))
    asked = parser.parse_args(args)
    spark = given.session("document index")
    try:
        run(spark, asked.documents, asked.out, asked.checkpoint, given.load(spark, asked.settings, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
