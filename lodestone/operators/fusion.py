"""Reciprocal rank fusion, candidate pools and their trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_ranks(ranking: DataFrame, by: list, id_col: str = "chunk_id") -> DataFrame:
    """1-based ranks per query after repeats of an id are dropped (the first stays)."""
    once = ranking.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    once = once.groupBy("query_id", id_col).agg(F.min("_at").alias("_at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_at"))).drop("_at")


def rrf(channels: dict[str, DataFrame], k: int = 60, id_col: str = "chunk_id", repeats: bool = True) -> DataFrame:
    """query_id, id, fusion_score, fusion_rank and each channel's rank.

    Channels hold query_id, id and rank.  An id that a channel repeats counts
    once, at its first place, and later ids move up; ``repeats`` False says
    that there are none and that ranks have no holes.  Score: the sum of
    1 / (k + rank); order: score, then id.
    """
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("k must be a positive integer")
    names = sorted(channels)
    if repeats:
        channels = {n: dense_ranks(rows, ["rank", id_col], id_col) for n, rows in channels.items()}
    rows = reduce(DataFrame.unionByName, [channels[n].select("query_id", id_col, F.col("rank"), F.lit(n).alias("channel")) for n in names])
    ranks = [F.min(F.when(F.col("channel") == n, F.col("rank"))).alias(f"{n}_rank") for n in names]
    fused = rows.groupBy("query_id", id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("fusion_score"), *ranks)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion_score", 12)), id_col)
    return fused.withColumn("fusion_rank", F.row_number().over(order))


def hybrid(dense: DataFrame, lexical: DataFrame, candidate_k: int = 40, rrf_k: int = 60, id_col: str = "chunk_id") -> DataFrame:
    """The candidate trace: both channels' ranks and scores, fusion, omission.

    Candidates beyond candidate_k stay in the trace, omitted by fusion_cap.
    """
    fused = rrf({"vector": dense.withColumnRenamed("vector_rank", "rank"), "lexical": lexical.withColumnRenamed("lexical_rank", "rank")}, rrf_k, id_col, repeats=False)
    trace = fused.join(dense.select("query_id", id_col, "vector_score"), ["query_id", id_col], "left")
    trace = trace.join(lexical.select("query_id", id_col, F.col("bm25").alias("lexical_score")), ["query_id", id_col], "left")
    return trace.withColumn("omission_reason", F.when(F.col("fusion_rank") > candidate_k, "fusion_cap"))


def counts(trace: DataFrame) -> DataFrame:
    """Per query: candidates of either channel, the pool, and those in both."""
    return trace.groupBy("query_id").agg(
        F.count("vector_rank").alias("vector_candidates"),
        F.count("lexical_rank").alias("lexical_candidates"),
        F.count(F.lit(1)).alias("fused_candidates"),
        F.count(F.when(F.col("omission_reason").isNull(), 1)).alias("pool"),
        F.count(F.when(F.col("vector_rank").isNotNull() & F.col("lexical_rank").isNotNull(), 1)).alias("in_both"),
    )


def apply_rerank(pool: DataFrame, scores: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Order by a reranker's scores; what it leaves out is marked, not dropped.

    ``scores``: query_id, id, rerank_score.  Unknown or repeated ids and
    scores that are not finite are errors.
    """
    counted = scores.groupBy("query_id", id_col).agg(F.count(F.lit(1)).alias("_n"), F.max("rerank_score").alias("rerank_score"))
    known = pool.filter("omission_reason is null").select("query_id", id_col, F.lit(True).alias("_known"))
    checked = counted.join(known, ["query_id", id_col], "left").withColumn(
        "rerank_score",
        F.when(F.col("_known").isNull(), F.raise_error(F.lit("the reranker returned an unknown id")).cast("double"))
        .when(F.col("_n") > 1, F.raise_error(F.lit("the reranker returned an id twice")).cast("double"))
        .when(F.isnan("rerank_score") | (F.abs("rerank_score") == float("inf")) | F.col("rerank_score").isNull(), F.raise_error(F.lit("the reranker's scores must be finite")).cast("double"))
        .otherwise(F.col("rerank_score")),
    )
    out = pool.join(checked.select("query_id", id_col, "rerank_score"), ["query_id", id_col], "left")
    reason = F.when(F.col("omission_reason").isNull() & F.col("rerank_score").isNull(), "reranker_omitted").otherwise(F.col("omission_reason"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "fusion_rank", id_col)
    return out.withColumn("omission_reason", reason).withColumn("final_rank", F.when(F.col("rerank_score").isNotNull(), F.row_number().over(order)))


def with_decisions(trace: DataFrame, selections: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The trace with final_role, and for every candidate that was not chosen why.

    ``selections``: query_id, items (id and role) and decisions (id and
    status), as context assembly gives them.  The last decision on a candidate
    counts; one that none mentions was not_selected.  Chosen passages that were
    no candidates, which links brought in, get rows of their own.
    """
    roles = selections.select("query_id", F.explode("items").alias("i")).select("query_id", F.col(f"i.{id_col}").alias(id_col), F.col("i.role").alias("final_role"))
    said = selections.select("query_id", F.posexplode("decisions").alias("at", "d")).filter(f"d.{id_col} is not null and d.status <> 'selected'")
    last = said.groupBy("query_id", F.col(f"d.{id_col}").alias(id_col)).agg(F.max_by("d.status", "at").alias("_last"))
    out = trace.join(roles, ["query_id", id_col], "full").join(last, ["query_id", id_col], "left")
    reason = F.when(F.col("final_role").isNull(), F.coalesce("omission_reason", "_last", F.lit("not_selected")))
    return out.withColumn("omission_reason", reason).drop("_last")
