"""Exact duplicates by distributed most-significant-digit radix partitioning.

Rows start in one group.  Each level reads the next digit (a run of bytes) of
every row whose group is not settled and splits the group by it.  A group of
one row, or one whose rows all ended inside the digit, is settled; only the
rest moves on, with the bytes it has yet to compare.  Equality is decided on
the bytes themselves; no digest takes part.

Digits widen from level to level (64 bytes, 1 KiB, 16 KiB, then 128 KiB), so
the number of levels grows with the logarithm of the texts' length up to
128 KiB and linearly after that, while the first narrow digit already settles
nearly every row that has no twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, whole_text

FIRST_DIGIT = 64
GROWTH = 16
WIDEST_DIGIT = 128 * 1024


def digit_width(level: int) -> int:
    return min(FIRST_DIGIT * GROWTH**level, WIDEST_DIGIT)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  Null text counts as
    empty text.  Rows that tie on both id and text are one another's copies
    and share the largest id, so all rows with it stay; a null id is smaller
    than any other, and a group of null ids only keeps its rows.  Extra
    columns of ``docs`` are ignored.  An empty input gives an empty result.
    ``text_sha256`` is informative and takes no part in the comparison.

    Skew: the per-digit counts combine before they are shuffled (a group of
    any size sends one row per task), and are written before the join back,
    so that join is a plain one that the engine may split where one group
    holds a large share of all rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "radix")
    live = docs.select(
        F.col(id_col).alias("id"),
        F.lit(0).cast("long").alias("gid"),
        F.sha2(whole_text(text_col), 256).alias("sha"),
        whole_text(text_col).cast("binary").alias("rest"),
    )
    settled, level = [], 0
    while True:
        width = digit_width(level)
        head = F.substring("rest", 1, width)
        groups = (
            live.select("id", "gid", head.alias("head"))
            .groupBy("gid", "head")
            .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
            .filter("n > 1")
            .withColumn("over", F.length("head") < width)
            .withColumn("sub", F.monotonically_increasing_id())
        )
        groups = work.save(groups, f"groups{level}")
        more = bool(groups.filter(~F.col("over")).take(1))
        split = live.withColumn("head", head).join(groups.hint("merge"), ["gid", "head"], "left")
        goes_on = F.col("over").isNotNull() & ~F.col("over")
        rows = split.select(
            "id",
            F.when(goes_on, F.col("sub")).alias("gid"),
            "sha",
            F.when(goes_on, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
            F.coalesce(F.col("n"), F.lit(1)).alias("n"),
        )
        if not more:
            settled.append(rows)
            break
        rows = work.save(rows, f"rows{level}")
        settled.append(rows.filter("gid is null"))
        live = rows.filter("gid is not null").select("id", "gid", "sha", "rest")
        level += 1
    out = settled[0].select("id", "sha", "keep", "n")
    for part in settled[1:]:
        out = out.unionByName(part.select("id", "sha", "keep", "n"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
