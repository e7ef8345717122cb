"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace


def _checksum(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, work: Workspace, label: str = "star") -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node.

    ``edges`` has long columns a and b.  Each round turns every node's larger
    neighbours to its least neighbour (large star) and then its smaller
    neighbours to the least of them (small star), until nothing changes; the
    edge list never grows beyond the number of distinct edges and nodes.
    Minima combine before they are shuffled and are written before they join
    the edges again, so a node with very many edges stays a splittable join.
    """
    now = work.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    before, turn = _checksum(now), 0
    while before[0]:
        turn += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-{turn}-low")
        large = both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.save(large, f"{label}-{turn}-large")
        low = work.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-{turn}-least")
        small = large.join(low.hint("merge"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = work.save(small, f"{label}-{turn}")
        after = _checksum(now)
        work.drop(f"{label}-{turn}-low", f"{label}-{turn}-large", f"{label}-{turn}-least", f"{label}-{turn - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
