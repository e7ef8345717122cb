"""Preference formatting of paired conversations, in native expressions.

Two conversations form a pair: a chosen and a rejected one.  Their longest
common prefix of turns (equal role and text) is rendered once as the prompt;
what follows on either side is its completion, with a mask of one character
per completion turn: 1 for turns to learn from, 0 for turns to skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED_ROLE = "assistant"


def _render(turns: Column) -> Column:
    """Each turn as <|role|>, line feed, text, <|end|>, line feed."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.when(t["role"] == LEARNED_ROLE, "1").otherwise("0")), "")


def format_pairs(turns: DataFrame, pair: Column, rejected: Column) -> DataFrame:
    """One row per pair that has a chosen or a rejected turn.

    ``turns`` has conv_id, turn, role and text; ``pair`` names a turn's pair
    and ``rejected`` (boolean) its side; rows with a null pair are left out.
    Turns are ordered by number, then role and text, so that ties and repeated
    rows have one order; a null number comes first.  Null role and text count
    as empty.  A pair with one side keeps it: the prompt is empty and the
    other completion is empty.  Identical sides are all prompt, with empty
    completions.  Extra columns are ignored; no rows give no rows.

    Columns: pair_id, chosen_id, rejected_id (least conv_id of the side, null
    if the side is missing), n_common, prompt, chosen, chosen_mask, rejected,
    rejected_mask.
    """
    rows = turns.select(
        pair.alias("pair_id"),
        F.coalesce(rejected, F.lit(False)).alias("side"),
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    ).filter("pair_id is not null")
    both = rows.groupBy("pair_id").agg(
        F.min(F.when(~F.col("side"), F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(F.col("side"), F.col("conv_id"))).alias("rejected_id"),
        F.array_sort(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("b"),
    )
    same = F.zip_with("a", "b", lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(F.transform(same, lambda e: F.coalesce(e, F.lit(False))), F.lit(False)).cast("int")
    shorter = F.least(F.size("a"), F.size("b"))
    both = both.withColumn("n", F.when(first > 0, F.least(first - 1, shorter)).otherwise(shorter))
    rest = lambda side: F.expr(f"slice({side}, n + 1, size({side}))")
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("n_common"),
        _render(F.expr("slice(a, 1, n)")).alias("prompt"),
        _render(rest("a")).alias("chosen"),
        _mask(rest("a")).alias("chosen_mask"),
        _render(rest("b")).alias("rejected"),
        _mask(rest("b")).alias("rejected_mask"),
    )


def other_replies(turns: DataFrame) -> DataFrame:
    """Pairs that fork at the last reply: each conversation as it is (chosen) and with another's last reply (rejected).

    The last reply is the assistant's turn of the highest number (of equal
    numbers the greatest text; repeated rows all change).  The other one is
    that of the conversation with the next number, or empty if there is none
    (as for ids that are no whole numbers).
    A conversation without a reply, or whose neighbour ends alike, is all
    prompt.  Rows with a null conv_id are left out.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = rows.filter(F.col("role") == LEARNED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    own_id = F.col("conv_id")
    next_one = last.select((own_id.try_cast("decimal(38,0)") - 1).try_cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("own.text").alias("other"))
    swap = last.join(next_one, "conv_id", "left").select("conv_id", "own", F.coalesce("other", F.lit("")).alias("other"))
    is_last = (F.col("role") == LEARNED_ROLE) & F.col("turn").eqNullSafe(F.col("own.turn")) & (F.col("text") == F.col("own.text"))
    rejected = rows.join(swap, "conv_id", "left").withColumn("text", F.when(is_last, F.col("other")).otherwise(F.col("text"))).select(*rows.columns)
    both = rows.withColumn("side", F.lit(False)).unionByName(rejected.withColumn("side", F.lit(True)))
    return format_pairs(both, F.col("conv_id"), F.col("side"))


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected)."""
    return format_pairs(turns, F.expr("conv_id div 2"), F.expr("pmod(conv_id, 2) = 1"))
