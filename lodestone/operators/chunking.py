"""Plain chunking: paragraphs, cut to size, with overlapping context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import SPACE, chapter_guess, strip
from lodestone.sources.scratch import saved


def pieces(text: Column, size: int = 800) -> Column:
    """Stripped paragraphs; those over size cut into windows of size."""
    whole = strip(F.coalesce(text, F.lit("")))
    paragraphs = F.filter(F.transform(F.split(whole, f"(?U)\\n[{SPACE}]*\\n+"), strip), lambda p: p != "")

    def cut(p: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: strip(p.substr(i * size + 1, F.lit(size))))
        return F.when(F.length(p) <= size, F.array(p)).otherwise(F.filter(windows, lambda w: w != ""))

    return F.flatten(F.transform(paragraphs, cut))


def overlap(size: int) -> int:
    return min(120, max(40, size // 8))


def split_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 800, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, sequence, chunk_id, clean_text, context_text, chapter, and the document's columns to ``keep``."""
    if size < 1:
        raise ValueError("size must be positive")
    # The chunk before is its neighbour in the array, so no window and no shuffle is needed.
    parts = docs.select(F.col(id_col).alias("doc_id"), *keep, pieces(F.col(text_col), size).alias("parts"))
    before = F.expr("if(size(parts) > 0, concat(array(cast(null as string)), slice(parts, 1, size(parts) - 1)), cast(array() as array<string>))")
    rows = parts.select("doc_id", *keep, F.posexplode(F.arrays_zip(F.col("parts").alias("clean_text"), before.alias("before"))).alias("sequence", "p"))
    return rows.select(
        "doc_id",
        "sequence",
        F.format_string("%s::chunk_%06d", F.col("doc_id").cast("string"), F.col("sequence")).alias("chunk_id"),
        F.col("p.clean_text").alias("clean_text"),
        F.when(F.col("p.before").isNotNull(), F.concat(F.expr(f"right(p.before, {overlap(size)})"), F.lit("\n"), "p.clean_text")).otherwise(F.col("p.clean_text")).alias("context_text"),
        chapter_guess(F.col("p.clean_text")).alias("chapter"),
        *keep,
    )


def comparison_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 800) -> DataFrame:
    """Chunks named by document position and sequence (d0:c0), positions by id."""
    # A sorted id's number holds its partition and its place there; the window runs over one row a partition.
    placed = saved(docs.select(F.col(id_col).alias("doc_id")).orderBy("doc_id").withColumn("at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = placed.join(F.broadcast(before), part == F.col("part")).select("doc_id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"))
    rows = split_documents(docs, id_col, text_col, size)
    return rows.join(place, "doc_id").withColumn("chunk_id", F.format_string("d%d:c%d", F.col("n"), F.col("sequence"))).drop("n")
