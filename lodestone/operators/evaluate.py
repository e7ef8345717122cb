"""Ranking and coverage metrics, and checks of evaluation datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import strip

CUTS = (5, 10)


def ranking_metrics(rankings: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """query_id, recall, mrr, ndcg at k for every query with a positive grade.

    ``rankings``: query_id, doc_id, rank (the first place of a document
    counts); ``relevance``: query_id, doc_id, grade 0 to 4.  A query without
    a ranking scores 0.
    """
    if type(k) is not int or k < 1:
        raise ValueError("k must be a positive integer")
    first = rankings.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    top = first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).filter(F.col("at") <= k)
    good = relevance.filter("grade > 0")
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("at") + 1)
    ideal = good.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("positives"), F.sum(F.when(F.col("at") <= k, gain)).alias("ideal"))
    hits = top.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("at").alias("first"), F.sum(gain).alias("dcg"))
    rows = ideal.join(hits, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("query_id", zero(F.col("hits") / F.col("positives")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def summarize(queries: DataFrame, runs: DataFrame, rankings: DataFrame, relevance: DataFrame) -> DataFrame:
    """One row: macro means at 5 and 10 over all queries, failures, latency.

    ``runs``: query_id, seconds, failed.  A failed query has no ranking, so
    it scores 0, and its time is left out of the successful percentiles.
    """
    fine = rankings.join(runs.filter("not failed").select("query_id"), "query_id", "left_semi")
    rows = queries.select("query_id").join(runs, "query_id", "left")
    means = []
    for k in CUTS:
        m = ranking_metrics(fine, relevance, k)
        rows = rows.join(m.select("query_id", *(F.col(c).alias(f"{c}_at_{k}") for c in ("recall", "mrr", "ndcg"))), "query_id", "left")
        means += [F.avg(F.coalesce(F.col(f"{c}_at_{k}"), F.lit(0.0))).alias(f"{c}_at_{k}") for c in ("recall", "mrr", "ndcg")]
    good = F.when(~F.col("failed"), F.col("seconds"))
    return rows.agg(
        *means,
        F.count(F.lit(1)).alias("queries"),
        F.count(F.when(F.col("failed"), 1)).alias("failed_queries"),
        F.percentile("seconds", 0.5).alias("p50_seconds"),
        F.percentile("seconds", 0.95).alias("p95_seconds"),
        F.percentile(good, 0.5).alias("successful_p50_seconds"),
        F.percentile(good, 0.95).alias("successful_p95_seconds"),
        F.when(F.sum("seconds") > 0, F.count(good) / F.sum("seconds")).alias("serial_successful_queries_per_second"),
    )


def latencies(rows: DataFrame, by: str, seconds: str) -> DataFrame:
    """by, p50, p95, median and n of each group's durations, by linear interpolation."""
    return rows.groupBy(by).agg(F.percentile(seconds, 0.5).alias("p50"), F.percentile(seconds, 0.95).alias("p95"), F.median(seconds).alias("median"), F.count(F.lit(1)).alias("n"))


def output_means(runs: DataFrame) -> DataFrame:
    """One row: the means of returned_chunks, returned_context_characters and, if there is such a column, returned_context_tokens.

    All runs count, failed ones with what they returned (null: nothing); a
    missing or wholly null token column gives a null mean.
    """
    zero = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    tokens = F.when(F.count("returned_context_tokens") > 0, zero("returned_context_tokens")) if "returned_context_tokens" in runs.columns else F.lit(None).cast("double")
    return runs.agg(zero("returned_chunks").alias("mean_returned_chunks"), zero("returned_context_characters").alias("mean_returned_context_characters"), tokens.alias("mean_returned_context_tokens"))


def returned_sizes(ranked: DataFrame, contexts: DataFrame, count_tokens=None) -> DataFrame:
    """query_id, returned_chunks, returned_context_characters (and returned_context_tokens, by a function of a text column) of every context."""
    chunks = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned_chunks"))
    rows = contexts.join(chunks, "query_id", "left")
    tokens = [count_tokens(F.col("context")).alias("returned_context_tokens")] if count_tokens else []
    return rows.select("query_id", F.coalesce("returned_chunks", F.lit(0)).alias("returned_chunks"), F.coalesce(F.length("context"), F.lit(0)).alias("returned_context_characters"), *tokens)


def stage_medians(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(F.median("seconds").alias("median_seconds"))


def coverage(results: DataFrame) -> DataFrame:
    """Per query source recall and MRR and reference coverage; null where unlabelled.

    Array columns: ranked document_ids; relevant; selected chunks as core_ids
    and supplement_ids; explicit_ids (supplements that a reference brought);
    target_ids; and exhaustive (boolean).
    """
    sources, relevant, targets = F.array_distinct("document_ids"), F.array_distinct("relevant"), F.array_distinct("target_ids")
    hit = F.filter(F.transform(sources, lambda d, i: F.when(F.array_contains("relevant", d), i + 1)), lambda x: x.isNotNull())
    ratio = lambda part, whole: F.when(F.size(whole) > 0, F.size(part) / F.size(whole))
    wrong = F.size(F.array_except("explicit_ids", "target_ids"))
    checked = F.col("exhaustive") & (F.size("explicit_ids") > 0)
    return results.select(
        "query_id",
        ratio(F.array_intersect(sources, relevant), relevant).alias("source_recall"),
        F.when(F.size(relevant) > 0, F.coalesce(1 / F.get(hit, 0), F.lit(0.0))).alias("source_mrr"),
        ratio(F.array_intersect(targets, F.array_union("core_ids", "supplement_ids")), targets).alias("reference_coverage"),
        ratio(F.array_intersect(targets, F.col("core_ids")), targets).alias("reference_core_coverage"),
        ratio(F.array_intersect(targets, F.col("supplement_ids")), targets).alias("reference_supplement_coverage"),
        F.when(F.col("exhaustive"), wrong).otherwise(0).alias("false_references"),
        F.when(F.col("exhaustive"), F.size(F.array_distinct("explicit_ids"))).otherwise(0).alias("explicit_evaluated"),
        F.when(checked, wrong / F.size(F.array_distinct("explicit_ids"))).alias("false_reference_expansion"),
    )


def aggregate_coverage(rows: DataFrame) -> DataFrame:
    """metric, value, denominator, status: null-aware means, and one micro ratio."""
    names = ["source_recall", "source_mrr", "reference_coverage", "reference_core_coverage", "reference_supplement_coverage"]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x"), F.when(F.col(n).isNotNull(), 1).otherwise(0).alias("d")) for n in names], F.struct(F.lit("false_reference_expansion").alias("metric"), F.col("false_references").cast("double").alias("x"), F.col("explicit_evaluated").alias("d")))).alias("m")).select("m.*")
    out = long.groupBy("metric").agg(F.sum("x").alias("x"), F.sum("d").cast("long").alias("denominator"))
    return out.select("metric", F.when(F.col("denominator") > 0, F.col("x") / F.col("denominator")).alias("value"), "denominator", F.when(F.col("denominator") > 0, "available").otherwise("unavailable").alias("status"))


def evidence_ranks(texts: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, points, found, reciprocal_rank of expected evidence in ranked texts.

    ``texts``: query_id, rank, normal (normalised text); ``expected``:
    query_id, point (normalised).
    """
    hits = expected.join(texts, "query_id").filter(F.col("normal").contains(F.col("point")))
    per_point = hits.groupBy("query_id", "point").agg(F.min("rank").alias("rank"))
    rows = expected.distinct().join(per_point, ["query_id", "point"], "left")
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("points"), F.count("rank").alias("found"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def leaking_documents(queries: DataFrame, relevance: DataFrame) -> DataFrame:
    """doc_id of documents that are positive for queries of both splits.

    queries: query_id, split (dev or test); relevance: query_id, doc_id, grade.
    """
    side = relevance.filter("grade > 0").join(queries.select("query_id", "split"), "query_id")
    return side.filter("split in ('dev', 'test')").groupBy("doc_id").agg(F.countDistinct("split").alias("n")).filter("n = 2").select("doc_id")


def dataset_violations(documents: DataFrame, queries: DataFrame, relevance: DataFrame, labels_required: bool = True) -> DataFrame:
    """rule, id of everything wrong with an evaluation dataset.

    documents: id, text; queries: id, question, split; relevance: query_id,
    doc_id, grade.  Positive documents must not serve both splits.
    """
    blank = lambda c: F.col(c).isNull() | (strip(F.col(c)) == "")
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), F.col("id").cast("string").alias("id"))
    repeated = lambda df: df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    positive = relevance.filter("grade > 0")
    crossing = positive.join(queries.select(F.col("id").alias("query_id"), "split"), "query_id").groupBy(F.col("doc_id").alias("id")).agg(F.countDistinct("split").alias("n")).filter("n > 1")
    found = [
        rule(repeated(documents), "duplicate document id"),
        rule(documents.filter(blank("text")), "empty document text"),
        rule(repeated(queries), "duplicate query id"),
        rule(queries.filter(blank("question")), "empty question"),
        rule(queries.filter(~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False))), "unknown split"),
        rule(relevance.filter(~F.coalesce(F.col("grade").between(0, 4), F.lit(False))).select(F.col("query_id").alias("id")), "grade out of range"),
        rule(relevance.select(F.col("doc_id").alias("id")).distinct().join(documents.select("id"), "id", "left_anti"), "unknown document"),
        rule(crossing, "document crosses splits"),
    ]
    if labels_required:
        found.append(rule(queries.join(positive.select(F.col("query_id").alias("id")), "id", "left_anti"), "no positive document"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dedupe_texts(rows: DataFrame, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """text, first (least order value), sources: equal trimmed texts become one."""
    text = strip(F.col(text_col))
    return rows.filter(text != "").groupBy(text.alias("text")).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(order)).alias("sources"))


def complete_groups(rows: DataFrame, group: str, member: str, needed: int) -> DataFrame:
    """Groups in which all ``needed`` kinds of member occur."""
    return rows.groupBy(group).agg(F.countDistinct(member).alias("kinds")).filter(F.col("kinds") == needed)
