"""Which document a question's scope names, for batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.containment import holding
from lodestone.sources.scratch import broadcast_if_small


def resolve(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """asked with doc_id and outcome: a document by id, else by its one exact name or path.

    ``asked`` has query_id and scope; ``documents`` doc_id, name, path and
    state.  Outcomes: all (a null scope), ok, unknown, ambiguous, incomplete.
    """
    names = documents.select("doc_id", "state", F.explode(F.array_distinct(F.array(F.col("doc_id").cast("string"), "name", "path"))).alias("scope")).filter("scope is not null")
    wanted = asked.select("scope").distinct().filter("scope is not null")
    hits = names.join(broadcast_if_small(wanted), "scope")
    best = hits.groupBy("scope").agg(
        F.max(F.when(F.col("scope") == F.col("doc_id").cast("string"), F.struct("doc_id", "state"))).alias("exact"),
        F.min(F.struct("doc_id", "state")).alias("least"),
        F.count(F.lit(1)).alias("n"),
    )
    one = F.coalesce("exact", F.when(F.col("n") == 1, F.col("least")))
    found = asked.join(broadcast_if_small(best.select("scope", one.alias("one"), F.lit(True).alias("known"))), "scope", "left")
    word = F.when(F.col("scope").isNull(), "all").when(F.col("known").isNull(), "unknown").when(F.col("one").isNull(), "ambiguous").when(F.col("one.state") != "complete", "incomplete").otherwise("ok")
    return found.select(*asked.columns, F.col("one.doc_id").alias("doc_id"), word.alias("outcome"))


def resolve_loosely(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """asked with resolved, as the older profiles have it: the first document whose id, name or path holds the scope, else the scope itself; null for none or a blank one."""
    said = F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("name", F.lit("")), F.coalesce("path", F.lit("")))
    wanted = asked.select(F.col("scope").alias("term")).distinct().filter("term <> ''")
    hits = holding(wanted, documents.select("doc_id", said.alias("said")), ["doc_id"], "said").groupBy("term").agg(F.min("doc_id").cast("string").alias("hit"))
    found = asked.join(broadcast_if_small(hits), F.col("scope") == F.col("term"), "left")
    return found.select(*asked.columns, F.when(F.col("scope") != "", F.coalesce("hit", "scope")).alias("resolved"))
