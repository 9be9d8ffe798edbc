"""Generated benchmark rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synth_t1(spark: SparkSession, n: int, parallelism: int, host_from: str = "localhost") -> DataFrame:
    """``n`` rows of the benchmark table split over workers; the first workers take the remainder."""
    share, rest = divmod(n, parallelism)
    cut = rest * (share + 1)
    position = F.col("id") - 1
    worker = F.when(position < cut, F.floor(position / (share + 1))).otherwise(
        rest + F.floor((position - cut) / max(share, 1))
    )
    return spark.range(1, n + 1, 1, parallelism).select(
        F.col("id"),
        F.col("id").cast("int").alias("k"),
        F.concat(F.lit("host-"), (worker + 1).cast("string")).alias("host"),
        F.lit(host_from).alias("hostfrom"),
        F.current_timestamp().alias("created_ts"),
        F.current_timestamp().alias("update_ts"),
        (worker + 1).cast("int").alias("worker"),
    )
