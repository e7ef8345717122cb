"""Tables of a running query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ConfigurationError


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below spark.checkpoint.dir; a local one only where that is unset and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ConfigurationError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str = "table", by: str | None = None) -> DataFrame:
    """df written once and read back, for plans that use it in several places; in folders by a column's values, if asked."""
    path = shared_folder(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than there are cores is dealt out over all.

    Large tables come in many partitions and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, most: int = 10_000, most_bytes: int = 64 << 20) -> bool:
    """Whether a pass shows at most ``most`` rows that take at most ``most_bytes`` as JSON."""
    size = F.sum(F.length(F.to_json(F.struct("*"))))
    seen = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("size")).first()
    return seen.n <= most and seen.size <= most_bytes


def broadcast_if_small(df: DataFrame, most: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """df marked for broadcast only after ``is_small`` has looked at it."""
    return F.broadcast(df) if is_small(df, most, most_bytes) else df
