"""Incremental ingestion: a stream of documents into an index, or into bare chunk tables.

``start_index`` commits every micro-batch to the index under the stream's id
and the batch's number, so retrieval sees a batch as a whole and one that is
replayed after a failure changes nothing.

``start_ingest`` writes chunks alone: each micro-batch writes its chunks to a folder of its stream and batch number,
so a batch replayed after a failure replaces itself and adds nothing, and
streams of different checkpoints never overwrite each other.  A document whose
id another batch has ingested is left as it is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.engine import Engine
from lodestone.operators.chunking import split_documents
from lodestone.sources.scratch import saved, shared_folder


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def start_index(stream: DataFrame, engine: Engine, checkpoint: str, format: str = "markdown", size: int = 800) -> StreamingQuery:
    """Every document of ``stream`` (doc_id, text, and name and path if known) into the engine's index.

    A document that the index holds is replaced.  Of the rows of one id in a
    batch the one of the greatest text stays; rows without an id are left out.
    Nothing of the index is read to tell old from new but the ids of the batch.
    """
    wanted = [c for c in ("text", "name", "path") if c in stream.columns]

    def commit(batch: DataFrame, number: int) -> None:
        own = _stream_id(batch.sparkSession, checkpoint)
        once = batch.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(*wanted)).alias("d")).select("doc_id", "d.*")
        engine.ingest(saved(once, "batch"), format=format, size=size, update=True, batch=(own, number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_ingest(stream: DataFrame, target: str, checkpoint: str, size: int = 800) -> StreamingQuery:
    """Chunk every new document of ``stream`` (doc_id, text) into ``target``/stream=id/batch=n.

    The id is the one that the stream's checkpoint holds from its first start on.
    """

    def commit(batch: DataFrame, number: int) -> None:
        own = _stream_id(batch.sparkSession, checkpoint)
        spark, fresh = batch.sparkSession, batch
        folder = spark._jvm.org.apache.hadoop.fs.Path(target)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            kind = batch.schema["doc_id"].dataType.simpleString()
            held = spark.read.schema(f"doc_id {kind}, stream string, batch long").parquet(target)
            others = held.filter((F.col("stream") != own) | (F.col("batch") != number)).select("doc_id")
            fresh = batch.join(others, "doc_id", "left_anti")
        split_documents(fresh, size=size).write.mode("overwrite").parquet(f"{target}/stream={own}/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the whole table through the stream: chunks per document."""
    root = shared_folder(spark, "ingest")
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # A file source reads a folder; the pattern admits a table of one file or of many.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/[d]ocuments.parquet")
    start_ingest(stream.select("doc_id", "text"), f"{root}/chunks", f"{root}/checkpoint").awaitTermination()
    rows = spark.read.option("basePath", f"{root}/chunks").parquet(f"{root}/chunks")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("clean_text")).alias("n_chars"))
