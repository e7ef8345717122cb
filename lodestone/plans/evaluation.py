"""Evaluation runs: datasets through the engine, or any other retriever, to metrics.

A retriever is a function from questions (query_id, question) to rankings
(query_id, doc_id, rank); the engine's profiles are some, and an adapter for
another system is one more.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.errors import ConfigurationError
from lodestone.functions.text import normalize_evidence
from lodestone.operators import evaluate
from lodestone.operators.profiles import PROFILES
from lodestone.sources.scratch import saved

Retriever = Callable[[DataFrame], DataFrame]


def checked(documents: DataFrame, queries: DataFrame, relevance: DataFrame, split: str | None = None, labels_required: bool = True) -> DataFrame:
    """The questions of a split (all if none); a dataset with violations is an error."""
    wrong = evaluate.dataset_violations(documents, queries, relevance, labels_required).take(3)
    if wrong:
        raise ConfigurationError("; ".join(f"{r.rule}: {r.id}" for r in wrong))
    rows = queries if split is None else queries.filter(F.col("split") == split)
    return rows.withColumnRenamed("id", "query_id")


def of_profile(engine: Engine, profile: str, top_k: int = 10) -> Retriever:
    def retrieve(queries: DataFrame) -> DataFrame:
        found = engine.retrieve(queries, profile, top_k)
        return found.join(engine.index.complete("chunks").select("chunk_id", "doc_id"), "chunk_id").select("query_id", "doc_id", "rank")

    return retrieve


def compare(systems: dict[str, Retriever], queries: DataFrame, relevance: DataFrame) -> DataFrame:
    """One row per system: quality at 5 and 10 and time.

    A batch is timed as a whole, and every question gets its even share.  A
    system that fails keeps its row: all its questions count as failed.
    """
    asked, n, out = queries.select("query_id", "question"), queries.count(), None
    empty = relevance.select("query_id", "doc_id", F.lit(0).alias("rank")).limit(0)
    for name, retrieve in systems.items():
        began, failed = time.perf_counter(), False
        try:
            rankings = saved(retrieve(asked), "rankings")
        except Exception:  # noqa: BLE001 - whatever a system raises is its failure
            rankings, failed = empty, True
        share = (time.perf_counter() - began) / max(1, n)
        runs = asked.select("query_id", F.lit(share).alias("seconds"), F.lit(failed).alias("failed"))
        row = evaluate.summarize(asked, runs, rankings, relevance).select(F.lit(name).alias("system"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def ablation(engine: Engine, queries: DataFrame, relevance: DataFrame, top_k: int = 10, profiles=tuple(PROFILES)) -> DataFrame:
    """The engine's profiles side by side."""
    return compare({p: of_profile(engine, p, top_k) for p in profiles}, queries, relevance)


def evidence(engine: Engine, queries: DataFrame, relevance: DataFrame, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(per question, summary) of the evidence profile: sources and references.

    ``queries``: query_id, question, and where labelled reference_target_ids
    and reference_targets_exhaustive.
    """
    found = saved(engine.retrieve(queries.select("query_id", "question", *(["scope"] if "scope" in queries.columns else [])), "evidence", top_k), "evidence")
    homes = engine.index.complete("chunks").select("chunk_id", "doc_id")
    items = found.select("query_id", F.explode("items").alias("i")).select("query_id", "i.*").join(homes, "chunk_id")
    by_role = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("chunk_id"))))
    sources = F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id"))), lambda s: s["doc_id"])
    rows = items.groupBy("query_id").agg(sources.alias("document_ids"), by_role("core").alias("core_ids"), by_role("supplement").alias("supplement_ids"))
    why = found.select("query_id", F.explode("reasons").alias("chunk_id", "r")).filter(F.exists("r", lambda r: r["kind"] == "explicit_reference"))
    why = why.join(items.filter("role = 'supplement'").select("query_id", "chunk_id"), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.collect_set("chunk_id").alias("explicit_ids"))
    good = relevance.filter("grade > 0").groupBy("query_id").agg(F.collect_set("doc_id").alias("relevant"))
    label = lambda c, kind, default: F.coalesce(F.col(c), default) if c in queries.columns else default.cast(kind)
    none = F.array().cast("array<string>")
    base = queries.select("query_id", label("reference_target_ids", "array<string>", none).alias("target_ids"), label("reference_targets_exhaustive", "boolean", F.lit(False)).alias("exhaustive"))
    for part in (rows, why, good):
        base = base.join(part, "query_id", "left")
    lists = ("document_ids", "core_ids", "supplement_ids", "explicit_ids", "relevant")
    per = evaluate.coverage(base.withColumns({c: F.coalesce(c, none) for c in lists}))
    return per, evaluate.aggregate_coverage(per)


def expected_evidence(engine: Engine, questions: DataFrame, profile: str, top_k: int = 6) -> DataFrame:
    """query_id, points, found, reciprocal_rank for questions with expected_evidence (array)."""
    ranked = engine.retrieve(questions.select("query_id", "question"), profile, top_k).join(engine.index.complete("chunks").select("chunk_id", "clean_text"), "chunk_id")
    texts = ranked.select("query_id", "rank", normalize_evidence(F.col("clean_text")).alias("normal"))
    points = questions.select("query_id", F.explode("expected_evidence").alias("p")).select("query_id", normalize_evidence(F.col("p")).alias("point"))
    return evaluate.evidence_ranks(texts, points)
