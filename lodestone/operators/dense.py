"""Exact dense retrieval: every query against every vector, in blocks.

Queries are the small side: QUERY_BYTES of them are sent to the executors as a
matrix for one scan of the vectors.  Each batch of vectors is scored by matrix
products of SCORES_AT_ONCE entries; a task keeps its best k per query over all
its batches and sends only those, and a window ranks what the tasks send.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

QUERY_BYTES, SCORES_AT_ONCE = 64 << 20, 4_000_000
#: Scores are compared to so many places, so that sums in another order tie alike.
PLACES = 9


class Best:
    """The k best (score, id) of one query so far: by rounded score, ties by id, null ids first."""

    def __init__(self, k: int):
        self.k, self.keys, self.scores, self.places = k, np.empty(0, dtype=object), np.empty(0), np.empty(0)

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        places = np.round(scores, PLACES)
        if len(self.keys) == self.k:
            ahead = places >= self.places.min()
            keys, scores, places = keys[ahead], scores[ahead], places[ahead]
        if not len(keys):
            return
        keys, scores, places = (np.concatenate(x) for x in ((self.keys, keys), (self.scores, scores), (self.places, places)))
        if len(keys) > self.k:
            least = np.partition(places, -self.k)[-self.k]
            above, level = np.flatnonzero(places > least), np.flatnonzero(places == least)
            first = nsmallest(self.k - len(above), level.tolist(), key=lambda i: (keys[i] is not None, keys[i]))
            stay = np.concatenate([above, np.array(first, dtype=np.int64)])
            keys, scores, places = keys[stay], scores[stay], places[stay]
        self.keys, self.scores, self.places = keys, scores, places


def _blocks(queries: DataFrame) -> Iterator[tuple[list, list, np.ndarray]]:
    ids, scopes, rows = [], [], []
    scoped = "scope" in queries.columns
    for r in queries.toLocalIterator():
        ids.append(r.query_id)
        scopes.append(r.scope if scoped else None)
        rows.append(np.array(r.embedding, dtype=float))
        if len(ids) * rows[0].nbytes >= QUERY_BYTES:
            yield ids, scopes, np.vstack(rows)
            ids, scopes, rows = [], [], []
    if ids:
        yield ids, scopes, np.vstack(rows)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 40, id_col: str = "chunk_id", scope_col: str | None = None) -> DataFrame:
    """query_id, id, vector_score, vector_rank: the k best by dot product, ties by id.

    ``queries``: query_id, embedding, and scope if scopes are used (null: all
    vectors).  Vectors of another dimension than the queries' are an error.
    """
    if k < 1:
        raise ValueError("k must be positive")
    id_field, query_field = vectors.schema[id_col], queries.schema["query_id"]
    id_arrow, query_arrow = to_arrow_type(id_field.dataType), to_arrow_type(query_field.dataType)
    schema = f"query_id {query_field.dataType.simpleString()}, `{id_col}` {id_field.dataType.simpleString()}, vector_score double, _places double"
    given = vectors.select(id_col, "embedding", *([scope_col] if scope_col else []))
    found = None
    for ids, scopes, matrix in _blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, scopes: list = scopes, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in ids]
            for batch in batches:
                column = batch.column(1)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                if len(flat) != len(column) * matrix.shape[1]:
                    raise ValueError("vectors and queries differ in dimension")
                keys = np.empty(len(column), dtype=object)
                keys[:] = batch.column(0).to_pylist()
                vectors = flat.reshape(len(column), matrix.shape[1]).T
                homes = np.array(batch.column(2).to_pylist(), dtype=object) if scope_col else None
                step = max(1, SCORES_AT_ONCE // max(1, len(column)))
                for first in range(0, len(ids), step):
                    scores = matrix[first : first + step] @ vectors
                    # Only what may be among a query's k best is looked at with its id: its score reaches the batch's k-th.
                    least = np.round(np.partition(scores, -k, axis=1)[:, -k], PLACES) if k < scores.shape[1] else np.full(len(scores), -np.inf)
                    for q, row in enumerate(scores, first):
                        if scopes[q] is not None and homes is not None:
                            at = homes == scopes[q]
                        else:
                            at = np.flatnonzero(np.round(row, PLACES) >= least[q - first])
                        best[q].add(keys[at], row[at])
            for q, found in zip(ids, best, strict=True):
                if len(found.keys):
                    arrays = [pa.array([q] * len(found.keys), query_arrow), pa.array(found.keys.tolist(), id_arrow), pa.array(found.scores, pa.float64()), pa.array(found.places, pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", id_col, "vector_score", "_places"])

        part = given.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = given.select(F.lit(None).cast(query_field.dataType).alias("query_id"), id_col, F.lit(0.0).alias("vector_score"), F.lit(0.0).alias("_places")).filter(F.lit(False))
    order = Window.partitionBy("query_id").orderBy(F.desc("_places"), id_col)
    return found.withColumn("vector_rank", F.row_number().over(order)).filter(F.col("vector_rank") <= k).drop("_places")


def all_scores(queries: DataFrame, vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """query_id, id, score: every query's dot product with every vector of its dimension.

    For what must be scored as a whole, such as topics: blocks of queries meet
    batches of vectors in matrix products, SCORES_AT_ONCE entries at a time.
    """
    id_field, query_field = vectors.schema[id_col], queries.schema["query_id"]
    query_arrow = to_arrow_type(query_field.dataType)
    schema = f"query_id {query_field.dataType.simpleString()}, `{id_col}` {id_field.dataType.simpleString()}, score double"
    given = vectors.select(id_col, "embedding")
    found = given.select(F.lit(None).cast(query_field.dataType).alias("query_id"), id_col, F.lit(0.0).alias("score")).filter(F.lit(False))
    for ids, _, matrix in _blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            asked, step = pa.array(ids, query_arrow), max(1, SCORES_AT_ONCE // max(1, len(ids)))
            for batch in batches:
                fit = np.flatnonzero(pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False) == matrix.shape[1])
                for first in range(0, len(fit), step):
                    part = batch.take(pa.array(fit[first : first + step]))
                    scores = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, matrix.shape[1]) @ matrix.T
                    places = [np.repeat(np.arange(part.num_rows), len(ids)), np.tile(np.arange(len(ids)), part.num_rows)]
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(places[1])), part.column(0).take(pa.array(places[0])), pa.array(scores.ravel())], names=["query_id", id_col, "score"])

        found = found.unionByName(given.mapInArrow(run, schema))
    return found
