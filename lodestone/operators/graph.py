"""Concepts, their co-occurrence graph and question expansion.

Substring matches between terms and concepts are equi-joins: a concept has at
most 24 characters, so the substrings of 2 to 24 characters on either side are
enumerated and joined, instead of comparing every term with every concept.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import candidates_of, query_terms, valid_concept
from lodestone.sources.scratch import broadcast_if_small, saved

SHORTEST, LONGEST = 2, 24
TEXTS_AT_ONCE = 256
#: Questions of a block, each a bit of a long.
BITS = 64


def ranked_concepts(text: Column, limit: int = 6) -> Column:
    """concept and n of a text of any length: the most frequent first, ties by first place; a few texts are counted at once."""

    @F.arrow_udf("array<struct<concept: string, n: bigint>>")
    def most(texts: pa.Array) -> pa.Array:
        # A counter keeps first places, and equal counts stay in their order.
        parts = (texts.slice(i, TEXTS_AT_ONCE).to_pylist() for i in range(0, len(texts), TEXTS_AT_ONCE))
        ranked = [Counter(candidates_of(t)).most_common(limit) for part in parts for t in part]
        ends = np.cumsum([0, *map(len, ranked)], dtype=np.int32)
        words, many = ([pair[i] for row in ranked for pair in row] for i in (0, 1))
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(many, pa.int64())], ["concept", "n"]))

    return most(text)


def chunk_concepts(chunks: DataFrame, limit: int = 6, id_col: str = "chunk_id", text_col: str = "clean_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, concept, n, place (1-based): the most frequent, ties by first place; and the chunk's columns to ``keep``.

    A row of ``chunks`` is counted where it is read, so nothing is shuffled.
    """
    rows = chunks.select(id_col, *keep, F.posexplode(ranked_concepts(F.col(text_col), limit)).alias("at", "c"))
    return rows.select(id_col, *keep, "c.concept", "c.n", (F.col("at") + 1).alias("place"))


def concept_edges(concepts: DataFrame, id_col: str = "chunk_id", by: tuple[str, ...] = ()) -> DataFrame:
    """source, target, weight: chunks that hold both concepts, each way; counted apart for each value of the columns ``by``."""
    return listed_edges(concepts.groupBy(id_col, *by).agg(F.collect_set("concept").alias("concepts")), by)


def listed_edges(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What ``concept_edges`` gives, of chunks with all their concepts in an array, a row a chunk.

    A pair is counted once and given both ways at the end.  Counts by columns
    are made where the rows of their values meet, arrays being smaller than
    the pairs they become.
    """
    own = chunks.select(*by, F.array_sort(F.array_distinct(F.filter("concepts", valid_concept))).alias("own"))
    own = own.repartition(*by) if by else own
    ones = own.select(*by, "own", F.posexplode("own").alias("at", "a"))
    pairs = ones.select(*by, "a", F.explode(F.expr("slice(own, at + 2, size(own))")).alias("b")).groupBy("a", "b", *by).agg(F.count(F.lit(1)).alias("weight"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))
    return pairs.select(F.explode(ways).alias("w"), *by, "weight").select("w.source", "w.target", *by, "weight")


def adjacency(edges: DataFrame) -> DataFrame:
    """source and a map of target to the summed weight; loops and weights below 1 are dropped."""
    fine = edges.filter("source <> target and weight > 0").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    return fine.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "weight")))).alias("targets"))


def substrings(text: Column) -> Column:
    """Distinct substrings of concept length."""
    none = F.array().cast("array<string>")
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length(text)))
    of = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, n))))
    return F.when(F.length(text) < SHORTEST, none).otherwise(F.array_distinct(of))


def touching(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """term, concept: distinct concepts that hold a distinct term or lie inside one.

    A term longer than any concept can only match from its inside.  No pair
    comes twice but that of equals, which ``around`` leaves out.
    """
    # A few MB of words become many times as many substrings, so they are dealt out first.
    n = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms, concepts = terms.repartition(n), concepts.repartition(n)
    inside = terms.select("term", F.explode(substrings(F.col("term"))).alias("concept")).join(concepts, "concept").select("term", "concept")
    parts = concepts.select("concept", F.explode(F.array_except(substrings(F.col("concept")), F.array("concept"))).alias("term"))
    around = terms.filter(F.length("term") >= SHORTEST).join(parts, "term").select("term", "concept")
    # A one-character term is in every concept that has the character.
    single = terms.filter(F.length("term") == 1).join(concepts.select("concept", F.explode(F.array_distinct(F.split("concept", ""))).alias("term")), "term")
    return inside.unionByName(around).unionByName(single.select("term", "concept"))


def question_terms(queries: DataFrame, text_col: str = "question") -> DataFrame:
    return queries.select("query_id", F.explode(query_terms(F.col(text_col))).alias("term")).filter("term <> ''")


def _asking(rows: DataFrame, key: str) -> DataFrame:
    """The questions of each value of ``key``: a bit each in the masks of its blocks."""
    return rows.groupBy(key, "block").agg(F.bit_or("mask").alias("mask"))


def related_terms(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """term, block, mask: the terms, the graph's concepts they touch, and their neighbours, with the questions that they are related to.

    ``terms``: term, block, mask.
    """
    nodes = edges.select(F.col("source").alias("concept")).distinct()
    hit = saved(_asking(touching(terms.select("term").distinct(), nodes).join(terms, "term"), "concept"), "touched")
    near = hit.join(edges, F.col("concept") == F.col("source")).select(F.col("target").alias("term"), "block", "mask")
    return _asking(terms.unionByName(hit.withColumnRenamed("concept", "term")).unionByName(near), "term")


def concept_hits(queries: DataFrame, concepts: DataFrame, edges: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """query_id, id, hits: the chunk's concepts that touch a related term.

    A chunk fetches a mask for each of its concepts; pairs of chunks and
    questions come last, in place.
    """
    own = concepts.select(id_col, "concept").distinct()
    numbers, masks = concept_masks(queries, own, edges)
    found = own.join(masks, "concept").groupBy(id_col, "block").agg(F.collect_list("mask").alias("masks"))
    pairs = found.join(broadcast_if_small(numbers), "block")
    counted = pairs.select("query_id", id_col, F.aggregate("masks", F.lit(0).cast("long"), lambda n, m: n + F.getbit(m, F.col("bit")).cast("long")).alias("hits"))
    return counted.filter("hits > 0")


def concept_masks(queries: DataFrame, concepts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, block, bit) of the questions that have terms, and (concept, block, mask): of ``concepts``, those that touch a related term.

    A question is a bit of a mask, 64 of them a block, so that terms and
    concepts are matched once for all questions.
    """
    asked = saved(question_terms(queries), "terms")
    # Any distinct numbers do; rows lie densely within a partition.
    numbers = saved(asked.select("query_id").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    numbers = numbers.select("query_id", F.shiftright("number", 6).alias("block"), (F.col("number") % BITS).cast("int").alias("bit"))
    terms = asked.join(broadcast_if_small(numbers), "query_id").select("term", "block", F.expr("shiftleft(1L, bit)").alias("mask"))
    related = saved(related_terms(saved(_asking(terms, "term"), "asked"), edges), "related")
    matched = touching(related.select("term").distinct(), concepts.select("concept").distinct())
    return numbers, _asking(matched.join(related, "term"), "concept")


def document_tree(chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """doc_id, chapter and its distinct concepts in order of appearance; chapters without any have an empty list."""
    named = concepts.groupBy("chunk_id").agg(F.collect_list(F.struct("place", "concept")).alias("ranked"))
    return listed_tree(chunks.select("doc_id", "chapter", "sequence", "chunk_id").join(named, "chunk_id", "left"))


def listed_tree(chunks: DataFrame) -> DataFrame:
    """What ``document_tree`` gives, of chunks with their concepts in an array ``ranked`` of place and concept; one shuffle of a row a chunk."""
    sequence = F.col("sequence")
    said = F.transform(F.coalesce("ranked", F.array().cast("array<struct<place: int, concept: string>>")), lambda c: F.struct(sequence.alias("sequence"), c["place"].alias("place"), c["concept"].alias("concept")))
    tree = chunks.select("doc_id", "chapter", said.alias("said")).groupBy("doc_id", "chapter").agg(F.collect_list("said").alias("c"))
    return tree.select("doc_id", "chapter", F.array_distinct(F.array_sort(F.flatten("c"))["concept"]).alias("concepts"))
