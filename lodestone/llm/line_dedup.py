"""Repeated line runs, by a distributed suffix array over line ids.

Lines become ids; the suffixes of all documents' id sequences are ranked by
prefix doubling: level k holds, in sorted order, the rank of every run of 2^k
lines that occurs more than once (a run that occurs once bounds no repeat and
leaves).  Going back down the levels, the suffixes are parted into the
longest-common-prefix intervals: an interval of common prefix L is split by
the rank of the 2^k lines after its prefix; each part of two or more suffixes
is an interval of prefix L + 2^k, and stays behind in the old one through its
earliest suffix only, which stands for all of it at shorter prefixes.  Every
suffix so meets the longest prefix that it shares with an earlier one.

A suffix is "earlier" by document id and line number.  Maximal repeated runs
of at least ``min_words`` words are deleted wherever they are later copies;
the first copy stays.

Every table here is narrow (ids, line numbers, ranks) but for the last join,
which brings the runs to the texts.  Ranks and minima are pre-aggregated and
written before they are joined back, so a line in a third of all documents
stays a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm.common import Workspace, fresh, whole_text

MIN_WORDS = 50
AT = ["did", "uid", "ln"]


def _ranked(keys: DataFrame, by: list[str], work: Workspace, name: str) -> DataFrame:
    """Keys that occur more than once, with their rank in sorted order.

    After a range-partitioned sort, partition and row number together rise
    with the key, which is what the generated id is made of.
    """
    again = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return work.save(again.orderBy(*by).withColumn("r", F.monotonically_increasing_id()), name)


def _did(docs: DataFrame, id_col: str):
    """The id as a key that orders and joins: null first, also among ids of other types than whole numbers."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))
    return F.struct(F.col(id_col).alias("id"))


def _uid(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), whole_text(text_col))


def previous_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """did, uid, ln, size: the longest run from line ln that occurs earlier.

    Only runs not inside the run of a line before, so that later runs also end
    later; did is the id as a key, uid tells documents apart that share an id.
    Lines are the same if two 64-bit hashes of them are.
    """
    work = work or Workspace(docs.sparkSession, "lines")
    lines = docs.select(
        _did(docs, id_col).alias("did"),
        _uid(id_col, text_col).alias("uid"),
        F.posexplode(F.split(whole_text(text_col), "\n")).alias("ln", "line"),
    )
    lines = work.save(lines.select(*AT, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")), "lines")
    ids = _ranked(lines, ["h1", "h2"], work, "ids")
    levels = [work.save(lines.join(ids.hint("merge"), ["h1", "h2"]).select(*AT, "r").distinct(), "level0")]
    work.drop("lines", "ids")
    while True:
        k, low = len(levels) - 1, levels[-1]
        right = low.select("did", "uid", (F.col("ln") - 2**k).alias("ln"), F.col("r").alias("r2"))
        pairs = work.save(low.join(right.hint("merge"), AT).select(*AT, F.col("r").alias("r1"), "r2"), f"pairs{k}")
        ranks = _ranked(pairs, ["r1", "r2"], work, f"ranks{k}")
        if not ranks.take(1):
            break
        levels.append(work.save(pairs.join(ranks.hint("merge"), ["r1", "r2"]).select(*AT, "r"), f"level{k + 1}"))
        work.drop(f"pairs{k}", f"ranks{k}")
    # Down the levels: every row is a suffix in an interval (node) of prefix lcp.
    now = levels[0].select(F.lit(0).cast("long").alias("node"), F.lit(0).alias("lcp"), F.lit(2**62).cast("long").alias("size"), F.lit(0).alias("best"), *AT)
    for k in range(len(levels) - 1, -1, -1):
        after = levels[k].select("did", "uid", F.col("ln").alias("ln_after"), "r")
        looked = now.withColumn("ln_after", F.expr("ln + lcp")).join(after.hint("merge"), ["did", "uid", "ln_after"], "left").drop("ln_after")
        looked = work.save(looked, f"looked{k}")
        parts = looked.filter("r is not null").groupBy("node", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*AT)).alias("first")).filter("n > 1")
        parts = work.save(parts.withColumn("child", F.monotonically_increasing_id() + F.lit((len(levels) - k) << 55)), f"parts{k}")
        moved = looked.join(parts.hint("merge"), ["node", "r"], "left")
        leads = "struct(did, uid, ln) = first"
        child = f"struct(child as node, lcp + {2**k} as lcp, n as size, if({leads}, best, lcp + {2**k}) as best)"
        stays = "struct(node, lcp, size, best)"
        moved = moved.select(*AT, F.expr(f"explode(case when n is null then array({stays}) when {leads} and n < size then array({child}, {stays}) else array({child}) end)").alias("x"))
        now = work.save(moved.select("x.*", *AT), f"nodes{k}")
        work.drop(f"looked{k}", f"parts{k}", f"nodes{k + 1}", f"level{k}" if k else "none")
    best = now.filter("best > 0").groupBy(*AT).agg(F.max("best").alias("size"))
    before = Window.partitionBy("did", "uid").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("reach", F.max(F.expr("ln + size")).over(before))
    return best.filter("reach is null or ln + size > reach").drop("reach")


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, with_runs: bool = True) -> DataFrame:
    """docs with later copies of repeated runs deleted from the text.

    All columns stay; ``line_runs`` is added unless ``with_runs`` is false, and
    then takes the place of a column of that name: array of structs (first
    line, number of lines) that were deleted, in order.  A run never crosses
    documents.  Null text stays null; a text whose lines all go becomes empty.
    Ids may be of any type that has an order.  Rows equal in id and text count
    as one document and change alike; null ids come first.  Words are runs of
    non-space characters.
    """
    work = Workspace(docs.sparkSession, "lines")
    runs = previous_runs(docs, id_col, text_col, work)
    runs = work.save(runs.groupBy("did", "uid").agg(F.array_sort(F.collect_list(F.struct("ln", "size"))).alias("runs")), "runs")
    work.drop("level0", "nodes0")
    did, uid, found, lines = fresh(docs, "did", "uid", "runs", "lines")
    runs = runs.select(F.col("did").alias(did), F.col("uid").alias(uid), F.col("runs").alias(found))
    keyed = docs.withColumns({did: _did(docs, id_col), uid: _uid(id_col, text_col)})
    out = keyed.join(runs.hint("merge"), [did, uid], "left")
    out = out.withColumn(lines, F.when(F.col(found).isNotNull(), F.split(whole_text(text_col), "\n")))
    long = f"filter({found}, x -> aggregate(slice({lines}, x.ln + 1, x.size), 0, (n, l) -> n + regexp_count(l, '\\\\S+')) >= {min_words})"
    out = out.withColumn(found, F.expr(f"coalesce({long}, cast(array() as array<struct<ln: int, size: int>>))"))
    # Runs end in the order in which they begin: what stays are the gaps between one's end and the next one's start.
    end = lambda x: f"{x}.ln + {x}.size"
    before = f"if(i = 0, 0, {end(f'{found}[greatest(i - 1, 0)]')})"
    gaps = f"transform({found}, (x, i) -> slice({lines}, {before} + 1, greatest(x.ln - {before}, 0)))"
    rest = f"slice({lines}, {end(f'element_at({found}, -1)')} + 1, size({lines}))"
    kept = f"array_join(concat(flatten({gaps}), {rest}), '\n')"
    out = out.withColumn(text_col, F.when(F.size(found) > 0, F.expr(kept)).otherwise(F.col(text_col)))
    if not with_runs:
        return out.select(*docs.columns)
    return out.select(*(c for c in docs.columns if c.lower() != "line_runs"), F.col(found).alias("line_runs"))
