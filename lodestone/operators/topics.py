"""Topics: leader clustering of each document's chunks, in sequence order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SIMILARITY = 0.78
TITLE_LENGTH = 60
#: Chunks, and topics, held as Python objects at once, besides those of one document.
ROWS_AT_ONCE = 1_000


def cluster(vectors: list[np.ndarray], least: float = SIMILARITY) -> list[int]:
    """Cluster number of each vector, in order; -1 for zero vectors.

    A vector joins the first cluster of greatest cosine if that reaches
    ``least`` and opens one otherwise; a centre is its members' mean direction.
    """
    sums, sizes, made = np.empty((0, 0)), np.empty(0), 0  # centres fill rows of a matrix that doubles
    out = []
    for v in vectors:
        size = float(np.linalg.norm(v)) if len(v) else 0.0
        if size == 0:
            out.append(-1)
            continue
        v = v / size
        near = sums[:made] @ v / sizes[:made] if made else sizes[:0]
        best = int(np.argmax(near)) if made else -1
        if best < 0 or near[best] < least:
            best, made = made, made + 1
            if best == len(sums):
                grown = max(16, 2 * best)
                sums = np.vstack([sums.reshape(-1, len(v)), np.zeros((grown - best, len(v)))])
                sizes = np.concatenate([sizes, np.ones(grown - best)])
        sums[best] += v
        sizes[best] = np.linalg.norm(sums[best]) or 1.0
        out.append(best)
    return out


def build_topics(chunks: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """topic_id, doc_id, title, centroid, chunk_ids of every document's topics.

    ``chunks``: doc_id, sequence, chunk_id, embedding, chapter and concepts
    (array, in extraction order).  Documents are dealt out whole, and a task
    takes one after the other.
    """
    kind = chunks.schema["doc_id"].dataType
    schema = f"topic_id string, doc_id {kind.simpleString()}, title string, centroid array<double>, chunk_ids array<string>"
    form = pa.schema([("topic_id", pa.string()), ("doc_id", to_arrow_type(kind)), ("title", pa.string()), ("centroid", pa.list_(pa.float64())), ("chunk_ids", pa.list_(pa.string()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                doc, chunk, chapter, concepts, vectors = batch.slice(i, ROWS_AT_ONCE).columns
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))
                yield from zip(doc.to_pylist(), chunk.to_pylist(), chapter.to_pylist(), concepts.to_pylist(), np.split(flat, ends[:-1]), strict=True)

    def topics(doc, members: list[tuple]) -> Iterator[tuple]:
        own: dict[int, list[tuple]] = {}
        for number, member in zip(cluster([m[4] for m in members], least), members, strict=True):
            if number >= 0:
                own.setdefault(number, []).append(member)
        for number, part in sorted(own.items()):
            names = dict.fromkeys(c for m in part for c in m[3])
            centre = np.mean(np.vstack([m[4] / (np.linalg.norm(m[4]) or 1.0) for m in part]), axis=0)
            yield f"{doc}::topic_{number:04d}", doc, " / ".join(names)[:TITLE_LENGTH] or part[0][2], centre / (np.linalg.norm(centre) or 1.0), [m[1] for m in part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (t for doc, members in groupby(rows(batches), itemgetter(0)) for t in topics(doc, list(members)))
        for some in batched(made, ROWS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), form, strict=True)], schema=form)

    wanted = chunks.select("doc_id", "chunk_id", "chapter", "concepts", "embedding", "sequence").repartition("doc_id").sortWithinPartitions("doc_id", "sequence")
    return wanted.drop("sequence").mapInArrow(run, schema)


def centroids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """group, place, value: the unit mean of each group's vectors, one row a component."""
    rows = vectors.select(by, F.posexplode("embedding").alias("place", "value"))
    mean = rows.groupBy(by, "place").agg(F.avg(F.col("value").cast("double")).alias("value"))
    size = mean.groupBy(by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    return mean.join(size, by).select(by, "place", F.when(F.col("size") > 0, F.col("value") / F.col("size")).otherwise(F.col("value")).alias("value"))
