"""Intervals and places on a line, per key: as-of lookup and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, begins: str, take: list[str]) -> DataFrame:
    """Every probe with the columns ``take`` of the last mark at or before it.

    Probes have ``keys`` and the place ``at``, marks have ``keys`` and the
    place ``begins``; null keys never match.  Of several marks at one place the
    greatest by ``take`` counts; a probe before the first mark, or at a null
    place, gets nulls.  Both sides are one stream per key, sorted once, so that
    a key costs no more than its rows; nothing is paired.
    """
    clash = [c for c in take if c in probes.columns]
    if clash:
        raise ValueError(f"the probes have columns of these names already: {clash}")
    kind = probes.schema[at].dataType
    one = marks.filter(F.col(begins).isNotNull()).groupBy(*keys, F.col(begins).cast(kind).alias("_at")).agg(F.max(F.struct(*take)).alias("_mark"))
    probe = F.struct(*(F.col(c) for c in probes.columns)).alias("_probe")
    asked = probes.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), probe)
    both = one.withColumn("_kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_kind")
    known = F.col("_at").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    last = F.when(known, F.last("_mark", True).over(order)).alias("_found")
    return both.select("_kind", "_probe", last).filter("_kind = 1").select("_probe.*", *(F.col(f"_found.{c}").alias(c) for c in take))


def merged(rows: DataFrame, keys: list[str], start: str, stop: str, *aggregates: Column, touching: bool = False) -> DataFrame:
    """keys, start, stop, members and the aggregates of every run of overlapping intervals.

    An interval joins a run if it starts before the run's furthest stop so
    far, or at it if ``touching``.  Nested and equal intervals fall together;
    intervals with a null end are left out.  One sort per key, no self-join.
    """
    order = Window.partitionBy(*keys).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = before.isNull() | (F.col(start) > before if touching else F.col(start) >= before)
    fine = rows.filter(F.col(start).isNotNull() & F.col(stop).isNotNull())
    runs = fine.withColumn("_opens", opens.cast("long")).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("members"), *aggregates).drop("_run")
