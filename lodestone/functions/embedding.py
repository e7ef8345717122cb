"""Embedding backends: text columns to vectors.

A backend is any function from a column of texts to a column of
array<double>.  The deterministic one needs no model; others can be
registered by name, such as a pandas UDF that loads a model once per worker.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 256
#: Texts held as Python strings at once.
TEXTS_AT_ONCE = 1_000


def embed_text(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """Counts of symbols by code and place, and half counts of pairs, of unit length."""
    folded = unicodedata.normalize("NFKC", text or "").lower()
    code = np.frombuffer("".join(folded.split()).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    single = np.bincount((code + 17 * np.arange(len(code))) % dimension, minlength=dimension).astype(float)
    pairs = np.bincount((31 * code[:-1] + code[1:]) % dimension, minlength=dimension) if len(code) > 1 else 0.0
    vector = single + 0.5 * pairs
    return vector / (np.sqrt((vector * vector).sum()) or 1.0)


def deterministic(dimension: int = DIMENSION) -> Callable[[Column], Column]:
    if dimension < 8:
        raise ValueError("dimension must be at least 8")

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(i, TEXTS_AT_ONCE).to_pylist() for i in range(0, len(texts), TEXTS_AT_ONCE))
        vectors = np.array([embed_text(t, dimension) for part in parts for t in part], dtype=float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimension), pa.array(vectors.reshape(-1)))

    return embed


def from_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32, normalize: bool = True) -> Callable[[Column], Column]:
    """A backend from a function that loads an encoder of lists of texts.

    The encoder, a local model or a client of a remote one, is loaded once per
    worker task; vectors are scaled to length one unless told otherwise.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            given, out = texts.fillna("").tolist(), []
            for i in range(0, len(given), batch_size):
                part = np.asarray(encode(given[i : i + batch_size]), dtype=float)
                if normalize:
                    part = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
                out += list(part)
            yield pd.Series(out, dtype=object)

    return embed


def unit(vector: Column) -> Column:
    """Scaled to length one; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def valid(vector: Column, dimension: int | None = None) -> Column:
    """Not empty, finite throughout, and of the dimension if one is given."""
    fine = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & (F.size(vector) == dimension) if dimension else fine


BACKENDS: dict[str, Callable[..., Callable[[Column], Column]]] = {"deterministic": deterministic}


def register(name: str, make: Callable[..., Callable[[Column], Column]]) -> None:
    BACKENDS[name] = make


def backend(name: str, **options) -> Callable[[Column], Column]:
    if name not in BACKENDS:
        raise ValueError(f"no embedding backend named {name}")
    return BACKENDS[name](**options)
