"""Functions for SQL users: register(spark) once per session."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.embedding import embed_text
from lodestone.functions.text import terms_of
from lodestone.operators.structure import CHUNK_FIELDS, parse_text


def register(spark: SparkSession) -> None:
    """parse_document(text, doc_id, format, size) as a table function, text_embedding(text) and lexical_terms(text)."""
    names = [f.split()[0] for f in CHUNK_FIELDS.split(", ")]

    @F.udtf(returnType=CHUNK_FIELDS)
    class ParseDocument:
        def eval(self, text: str, doc_id: str, format: str, size: int):
            for chunk in parse_text(text or "", doc_id, format, size):
                yield tuple(chunk[n] for n in names)

    @F.pandas_udf("array<double>")
    def text_embedding(texts: pd.Series) -> pd.Series:
        return texts.map(embed_text)

    @F.pandas_udf("string")
    def compatibility_form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    @F.pandas_udf("array<string>")
    def lexical_terms(texts: pd.Series) -> pd.Series:
        return texts.map(terms_of)

    spark.udf.register("compatibility_form", compatibility_form)
    spark.udf.register("lexical_terms", lexical_terms)
    spark.udtf.register("parse_document", ParseDocument)
    spark.udf.register("text_embedding", text_embedding)
