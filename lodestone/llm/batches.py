"""Bounded slices of Arrow batches for operators that work text by text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters (or bytes) of text worked on at once; one longer text makes a slice alone.
SLICE_CHARS = 4_000_000


#: Bytes of an Arrow batch between the engine and its Python workers, both ways in memory at once.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES; a lower bound of its own stays.

    Rows of ten thousand long texts are not to meet in one batch.  Only the
    transport's portions change, never a result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of freed memory.

    Workers live on from stage to stage; else each holds its highest peak so far.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive (first row, texts) slices of about ``most`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def row_slices(batch: pa.RecordBatch, at: int, most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch whose column ``at`` holds about ``most`` bytes, with its texts (null as empty).

    Only one part's texts exist as Python strings at a time.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part.column(at).to_pylist()]
        start = stop


class BoundedCache(dict):
    """A dict that loses its older half when its entries pass its bound: only speed depends on it.

    Without a weight the bound counts entries; else whoever adds an entry adds
    what it holds to ``weight``.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.weight = most, 0

    def make_room(self) -> None:
        if max(len(self), self.weight) > self.most:
            for key in list(islice(self, len(self) // 2)):
                del self[key]
            self.weight //= 2


class RecentCache(BoundedCache):
    """A BoundedCache of two generations: entries of the older that are used move to the younger, the rest is lost with it.

    Either generation may reach the bound.
    """

    def __init__(self, most: int):
        super().__init__(most)
        self.older: dict = {}
        self.missed, self.misses = {}, 0

    def make_room(self) -> None:
        if max(len(self), self.weight) > self.most:
            self.older = dict(self)
            self.clear()
            self.weight = 0

    def __missing__(self, key):
        """An entry of the older generation; else the key is noted once in ``missed`` and stands for no bytes."""
        held = self.older.pop(key, None)
        if held is not None:
            self[key] = held
            self.weight += 200 + 2 * (len(key) + len(held))
            return held
        self.misses += 1
        self.missed[key] = None
        return b""

    def joined(self, sequences: list[list], learn: Callable[[list], None]) -> list[bytes]:
        """The entries of each sequence of keys, strung together; ``learn`` puts in entries of unknown keys.

        A sequence is looked up once, and again only if it held an unknown key.
        """
        self.make_room()
        self.missed, self.misses = {}, 0
        get, out, again = self.__getitem__, [], []
        for i, keys in enumerate(sequences):
            before = self.misses
            out.append(b"".join(map(get, keys)))
            if self.misses > before:
                again.append(i)
        if again:
            learn(list(self.missed))
            for i in again:
                out[i] = b"".join(map(get, sequences[i]))
        return out


def map_texts(docs: DataFrame, id_col: str, text_col: str, columns: dict[str, tuple[str, pa.DataType]], work: Callable[..., list[list]], with_ids: bool = False) -> DataFrame:
    """Run ``work`` over whole texts (null as empty), keeping each row's id.

    ``work`` takes the texts, and their ids too if asked.  ``columns`` names the output columns with their SQL and Arrow types, in
    the order of the lists that ``work`` returns.  Ids pass as Arrow values,
    so nulls and large integers survive.
    """

    def worked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, texts in row_slices(batch, 1):
            made = work(texts, part.column(0).to_pylist()) if with_ids else work(texts)
            arrays = [pa.array(v, type=kind) for v, (_, kind) in zip(made, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["id", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from worked(batch)
            give_back()

    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`id` {id_type}", *(f"`{n}` {sql}" for n, (sql, _) in columns.items())])
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def filter_texts(docs: DataFrame, text_col: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """Rows for whose whole text (null as empty) ``keep`` says true; all columns stay.

    Rows pass through as Arrow batches and leave slice by slice, so neither
    side holds more than a batch and one slice's texts.
    """
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in row_slices(batch, at):
                yield part.filter(pa.array(keep(texts), pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
