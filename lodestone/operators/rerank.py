"""Model rerankers: scores of (question, passage) pairs in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Predict = Callable[[list[tuple[str, str]]], Sequence[float]]


def pairwise(load: Callable[[], Predict], batch_size: int = 32) -> Callable[[DataFrame], DataFrame]:
    """A reranker for the engine from a function that loads a pair model.

    The model is loaded once per worker task and sees ``batch_size`` pairs at
    a time.  Every pair is scored, so nothing is left out.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for questions, passages in batches:
            pairs = list(zip(questions.fillna(""), passages.fillna(""), strict=True))
            made = [float(s) for i in range(0, len(pairs), batch_size) for s in predict(pairs[i : i + batch_size])]
            if len(made) != len(pairs):
                raise ValueError("the model must score every pair")
            yield pd.Series(made, dtype=float)

    return lambda pairs: pairs.select("query_id", "chunk_id", score("question", "clean_text").alias("rerank_score"))
