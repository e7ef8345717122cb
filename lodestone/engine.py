"""The engine: an index, ingestion into it, and retrieval for batches of questions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.errors import ConfigurationError, StorageError
from lodestone.functions import embedding
from lodestone.functions.text import strip
from lodestone.operators import assemble, chunking, dense, fusion, graph, lexical, links, profiles, scopes, structure, topics
from lodestone.sources import readers
from lodestone.sources.index import Index, checked_scopes
from lodestone.sources.scratch import saved

#: Names of retrieval modes and the profiles they stand for.
MODES = {"embedding": "vector", "embedding_graph": "full", "evidence": "evidence"} | {p: p for p in profiles.PROFILES}

Reranker = Callable[[DataFrame], DataFrame]


class Engine:
    """A reranker takes (query_id, question, chunk_id, clean_text) and returns query_id, chunk_id, rerank_score."""

    def __init__(self, index: Index, config: Config | None = None, embed: Callable[[Column], Column] | None = None, reranker: Reranker | None = None):
        self.index, self.config = index, config or Config()
        if self.config.enable_reranker and reranker is None:
            raise ConfigurationError("the settings ask for a reranker, but none is given")
        self.embed = embed or embedding.backend(self.config.embedding_backend)
        self.reranker, self.timings = reranker, {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config | None = None, kind: str = "evidence", **options) -> Engine:
        return cls(Index.create(spark, path, kind), config, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None, **options) -> Engine:
        made = cls(Index(spark, path), config, **options)
        made.index.check_embedding(made.identity)
        return made

    @property
    def spark(self) -> SparkSession:
        return self.index.spark

    @property
    def identity(self) -> str:
        return f"{self.config.embedding_backend}:{self.config.embedding_model}"

    # -- ingestion

    def ingest(self, documents: DataFrame, format: str = "markdown", size: int = 800, update: bool = False, batch: tuple[str, int] | None = None) -> None:
        """Documents (doc_id, text, and name and path if known), all at once; known ones are an error, or replaced if ``update``."""
        named = documents.withColumn("doc_id", F.col("doc_id").cast("string"))
        for column in ("name", "path"):
            if column not in named.columns:
                named = named.withColumn(column, F.col("doc_id"))
        self._add(named, structure.parse_documents(named, format=format, size=size), update, batch)

    def ingest_files(self, *paths: str, size: int = 800, pages_of=readers.pdf_pages, update: bool = False) -> None:
        found = readers.files(self.spark, *paths)
        self._add(found, readers.parse_files(found, size, pages_of), update)

    def _add(self, documents: DataFrame, parsed: DataFrame, update: bool = False, batch: tuple[str, int] | None = None) -> None:
        self.index.check_embedding(self.identity, record=True)
        self.index.add_all(documents, parsed.withColumn("embedding", self.embed(F.col("clean_text"))), update=update, batch=batch)

    def ingest_plain(self, documents: DataFrame, size: int = 800, update: bool = False) -> None:
        """Plain chunks with concepts, their graph and topics, for the graph profiles."""
        self.index.check_embedding(self.identity, record=True)
        named = documents.withColumn("doc_id", F.col("doc_id").cast("string"))
        rows = chunking.split_documents(named, size=size).withColumn("embedding", self.embed(F.col("clean_text")))
        names = named.select("doc_id", *(F.col(c) if c in named.columns else F.col("doc_id").alias(c) for c in ("name", "path")))

        def derived(written: DataFrame) -> dict[str, DataFrame]:
            themed = written.withColumn("concepts", F.transform(graph.ranked_concepts(F.col("clean_text")), lambda c: c["concept"]))
            return {"concepts": graph.chunk_concepts(written, keep=("doc_id",)), "edges": graph.listed_edges(themed, by=("doc_id",)), "topics": topics.build_topics(themed)}

        self.index.add_all(names, rows, with_links=False, update=update, derived=derived)

    def prepare(self, documents: DataFrame, format: str = "markdown", size: int = 800) -> None:
        """Save parsed chunks of all documents before any is embedded."""
        self.index.prepare(documents, structure.parse_documents(documents, format=format, size=size))

    def resume_all(self) -> DataFrame:
        """Embed what prepared documents still lack, in waves of whole documents; doc_id of those completed."""
        self.index.check_embedding(self.identity, record=True)
        return self.index.resume(self.embed, self.config.resume_chunks)

    def resume(self) -> list[str]:
        """As ``resume_all``, for a number of documents whose ids fit on the driver."""
        return sorted(r.doc_id for r in self.resume_all().collect())

    # -- reading

    def documents(self) -> DataFrame:
        return self.index.documents().orderBy("doc_id")

    def progress(self) -> DataFrame:
        return self.documents().select("doc_id", "processed_chunks", "total_chunks", "state")

    def tree(self) -> DataFrame:
        """doc_id, chapter and the distinct concepts in order of appearance."""
        rows = self.index.complete("chunks")
        found = self.index.table("concepts")
        if found is None:
            return rows.select("doc_id", "chapter", F.array().cast("array<string>").alias("concepts")).distinct()
        return graph.document_tree(rows, found)

    def reset(self, backup: bool = True) -> str | None:
        return self.index.reset(backup)

    # -- retrieval

    def _asked(self, queries: DataFrame, loosely: bool = False) -> DataFrame:
        """Questions with resolved scopes; blank ones are kept for their empty answer.

        A scope must name one complete document; ``loosely``, a part of its id,
        name or path will do, and what names none finds nothing.
        """
        if "scope" not in queries.columns:
            return queries
        known = self.index.documents()
        if loosely:
            return scopes.resolve_loosely(queries, known).withColumn("scope", F.col("resolved")).drop("resolved")
        asked = queries.select("scope").distinct()
        found = checked_scopes(scopes.resolve(asked, known)).select("scope", F.col("doc_id").alias("resolved"))
        return queries.join(found, queries["scope"].eqNullSafe(found["scope"]), "left").drop(found["scope"]).withColumn("scope", F.col("resolved")).drop("resolved")

    def check_profile(self, profile: str) -> None:
        can = self.index.capabilities()
        if profile == "evidence":
            if not can["evidence_ready"]:
                raise StorageError("the index holds no complete document to search")
            return
        if profile not in profiles.PROFILES:
            raise ConfigurationError(f"unknown profile: {profile}")
        use = profiles.PROFILES[profile]
        if not can["vector"] or use.graph and not can["graph"] or use.topic and not can["topic"]:
            raise StorageError(f"the index cannot serve {profile}")

    def retrieve(self, queries: DataFrame, profile: str | None = None, top_k: int | None = None, count_tokens: Callable[[str], int] | None = None) -> DataFrame:
        """Evidence: query_id and the selection; other profiles: ranked chunks.

        ``queries``: query_id, question and optionally scope.
        """
        profile = profile or self.config.retrieval_profile
        self.check_profile(profile)
        began = time.perf_counter()
        queries = self._asked(queries, loosely=profile != "evidence")
        asked = queries.filter(strip(F.col("question")) != "").withColumn("embedding", self.embed(F.col("question")))
        rows = self.index.complete("chunks")
        self.timings["scope"] = time.perf_counter() - began
        if profile != "evidence":
            own, edges, found = (self.index.table(t) for t in ("concepts", "edges", "topics"))
            return profiles.retrieve(profile, asked, rows, own, edges, found, top_k or self.config.final_top_k, recall_k=self.config.vector_recall_k, reranker=self.reranker)
        return self._select(queries, self.trace(asked, rows, self._options(top_k)), rows, self._options(top_k), count_tokens)

    def _options(self, top_k: int | None) -> assemble.Options:
        return self.config.options if top_k is None else replace(self.config.options, max_chunks=top_k)

    def _select(self, queries: DataFrame, pool: DataFrame, rows: DataFrame, options: assemble.Options, count_tokens: Callable[[str], int] | None) -> DataFrame:
        score, rank = ("rerank_score", "final_rank") if self.reranker else ("fusion_score", "fusion_rank")
        ranked = pool.filter("omission_reason is null").select("query_id", "chunk_id", F.col(rank).alias("rank"), F.col(score).alias("score"))
        stored = self.index.table("links")
        linked = links.link_targets(ranked, stored if stored is not None else links.build_links(rows.limit(0)), rows.drop("embedding"))
        return assemble.assemble_contexts(ranked, linked, rows.drop("embedding"), options, queries, count_tokens)

    def explain(self, queries: DataFrame, top_k: int | None = None, count_tokens: Callable[[str], int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Evidence retrieval with what led to it: (selections, details, counts), each written once.

        details: every candidate with ranks, scores, final_role or
        omission_reason.  counts: vector_candidates, lexical_candidates,
        candidate_union, fused_candidates, reranked_candidates and selected of
        every question.  ``timings`` then holds the seconds of all stages, each
        run and written on its own.
        """
        self.check_profile("evidence")
        self.timings = {}
        timed = self._timed
        queries = timed("scope", lambda: saved(self._asked(queries), "asked"))
        options, rows = self._options(top_k), self.index.complete("chunks")
        asked = timed("query_embedding", lambda: saved(queries.filter(strip(F.col("question")) != "").withColumn("embedding", self.embed(F.col("question"))), "embedded"))
        pool = self.trace(asked, rows, options, timed)
        selected = timed("selection_context", lambda: saved(self._select(queries, pool, rows, options, count_tokens), "selected"))
        details = saved(fusion.with_decisions(pool, selected), "details")
        held = lambda c: F.count(F.when(c, 1))
        per = pool.groupBy("query_id").agg(
            F.count("vector_rank").alias("vector_candidates"),
            F.count("lexical_rank").alias("lexical_candidates"),
            F.count(F.lit(1)).alias("candidate_union"),
            held(~F.col("omission_reason").eqNullSafe("fusion_cap")).alias("fused_candidates"),
            (held(~F.col("omission_reason").eqNullSafe("fusion_cap")) if self.reranker else F.lit(0)).cast("long").alias("reranked_candidates"),
        )
        sizes = selected.select("query_id", F.size("items").cast("long").alias("selected"))
        counts = sizes.join(per, "query_id", "left").na.fill(0)
        return selected, details, counts

    def _timed(self, stage: str, work: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        out = work()
        self.timings[stage] = time.perf_counter() - began
        return out

    def trace(self, asked: DataFrame, rows: DataFrame | None = None, options: assemble.Options | None = None, timed: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> DataFrame:
        """Every candidate with its ranks, scores and why it was left out; ``timed`` runs each stage on its own."""
        options = options or self.config.options
        rows = rows if rows is not None else self.index.complete("chunks")
        step = (lambda name, df: timed(name, lambda: saved(df, name))) if timed else (lambda name, df: df)
        scoped = "scope" in asked.columns
        near = step("vector_recall", dense.dense_topk(asked.select("query_id", "embedding", *(["scope"] if scoped else [])), rows, options.candidate_k, scope_col="doc_id" if scoped else None))
        stats, index = self.index.statistics(), self.index.postings_of(lexical.question_terms(asked))
        seen = rows.select("chunk_id", F.col("doc_id").alias("scope")) if scoped else rows.select("chunk_id", F.lit(None).cast("string").alias("scope"))
        with_scope = asked if scoped else asked.withColumn("scope", F.lit(None).cast("string"))
        words = step("lexical", lexical.bm25_topk(with_scope, index, stats, options.lexical_k, visible=seen))
        pool = step("fusion", fusion.hybrid(near, words, options.candidate_k, options.rrf_k))
        if self.reranker is None:
            return pool
        pairs = pool.filter("omission_reason is null").select("query_id", "chunk_id").join(asked.select("query_id", "question"), "query_id").join(rows.select("chunk_id", "clean_text"), "chunk_id")
        return step("rerank", fusion.apply_rerank(pool, self.reranker(step("chunk_data", pairs))))

    def retrieve_text(self, question: str, scope: str | None = None, profile: str | None = None) -> tuple[str, str, str]:
        """(path, comma-joined chunk ids, context) of one question."""
        asked = self.spark.createDataFrame([(1, question, scope)], "query_id long, question string, scope string")
        name = profile or self.config.retrieval_profile
        if name == "evidence":
            selected, _, counts = self.explain(asked)
            r, n = selected.first(), counts.first()
            return f"evidence recall {n.candidate_union} -> fusion {n.fused_candidates} -> selected {n.selected}", ",".join(x.chunk_id for x in r["items"]), r.context
        out = saved(self.retrieve(asked, name), "retrieved")
        r, n = profiles.render_context(out, self.index.complete("chunks")).first(), out.agg(F.coalesce(F.max("candidates"), F.lit(0)).alias("n")).first().n
        ids = r.chunk_ids if r else ""
        return f"{name} recall {n} -> selected {len(ids.split(',')) if ids else 0}", ids, r.context if r else ""

    def retrieve_semantic(self, question: str, scope: str | None = None, mode: str = "embedding_graph") -> tuple[str, str, str]:
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode}")
        return self.retrieve_text(question, scope, MODES[mode])


def answer_messages(question: str, context: str) -> list[dict[str, str]]:
    """Messages for a language model that must answer from the context alone."""
    system = "Answer only from the numbered passages. Lead with the answer, then cover who, when, how much, in what unit, why and under which conditions. Say so where the passages are silent. Cite passages as [S1] after each fact."
    return [{"role": "system", "content": system}, {"role": "user", "content": f"Question:\n{question}\n\nPassages:\n{context}"}]


def answer(client: Callable[[list[dict[str, str]]], str], question: str, context: str) -> str:
    return client(answer_messages(question, context)).strip()
