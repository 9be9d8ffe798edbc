"""Buffer pool snapshots and status counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.bands import io_band, resize_progress, resize_stage
from opslens.functions.units import human_bytes, safe_percent
from opslens.operators.filters import object_filter
from opslens.functions.text import contains_literal

PAGE_BYTES = 16384
MIB = 1024.0 * 1024.0
POOL_COLUMNS = (
    "pool_size", "free_buffers", "database_pages", "modified_database_pages",
    "pages_read_rate", "pages_made_young", "pages_not_made_young",
)


def pool_global(df: DataFrame, per: Sequence[str] = ("server", "snapshot_ts")) -> DataFrame:
    """All pool instances of a server together, with the share of modified pages."""
    sums = df.groupBy(*per).agg(*[F.sum(c).alias(c) for c in POOL_COLUMNS])
    return sums.withColumn(
        "dirty_pct", safe_percent(F.col("modified_database_pages"), F.col("database_pages"))
    ).withColumn("io_band", io_band(F.col("pages_read_rate")))


def pages_by_index(df: DataFrame, table: str | None = None) -> DataFrame:
    """Pool pages per index."""
    if table:
        df = df.filter(contains_literal(F.col("table_name"), table))
    return df.groupBy("index_name").agg(
        F.count(F.lit(1)).alias("pages"),
        F.round(F.count(F.lit(1)) * PAGE_BYTES / MIB, 2).alias("allocated_mib"),
        F.round(F.sum("data_size") / MIB, 2).alias("data_mib"),
        F.count_if(F.col("is_old") == "YES").alias("old_pages"),
        F.count_if(F.col("is_hashed") == "YES").alias("hashed_pages"),
    )


IMPACT_METRICS = ("pages", "allocated", "data", "pages_old", "pages_hashed", "rows_cached")


def impact(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("object_name",)) -> DataFrame:
    """Metrics of every table before and after a workload; a table absent from one side counts zero."""

    def long(df: DataFrame, name: str) -> DataFrame:
        metrics = [F.col(m).cast("long").alias(m) for m in IMPACT_METRICS]
        return df.select(*keys, *metrics).unpivot(list(keys), list(IMPACT_METRICS), "metric", name)

    both = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full")
    zero = F.lit(0)
    return both.select(
        *keys, "metric",
        F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"),
        (F.coalesce("after", zero) - F.coalesce("before", zero)).alias("change"),
    )


def status_pivot(df: DataFrame, names: Sequence[str], per: Sequence[str] = ("server", "ts")) -> DataFrame:
    """One column per counter name."""
    return df.filter(F.col("name").isin(list(names))).groupBy(*per).pivot("name", list(names)).agg(F.max("value"))


def resize_status(pivoted: DataFrame) -> DataFrame:
    """Stage, progress and target size of a pool resize from its status columns."""
    return pivoted.withColumn("stage", resize_stage(F.col("resize_code"))).withColumn(
        "progress", resize_progress(F.col("resize_code"), F.col("resize_progress"))
    ).withColumn(
        "target", F.coalesce(human_bytes(F.col("pool_bytes").cast("string").try_cast("double")), F.lit("N/A"))
    )


def resize_outcome(df: DataFrame, per: Sequence[str] = ("server",)) -> DataFrame:
    """Where a resize stands: the latest code per server, done at 0 and failed at 7."""
    last = df.groupBy(*per).agg(F.max("ts").alias("ts"), F.max_by("resize_code", "ts").alias("resize_code"))
    code = F.col("resize_code").cast("string")
    return last.withColumn("stage", resize_stage(F.col("resize_code"))).withColumn(
        "outcome", F.when(code == "0", "DONE").when(code == "7", "FAILED").otherwise("RUNNING")
    )


def top_objects(df: DataFrame, k: int = 10, contains: str | None = None) -> DataFrame:
    """Largest tables of the pool."""
    if k < 1:
        raise ValueError("k must be positive")
    named = df.withColumn("object", F.concat_ws(".", "object_schema", "object_name"))
    return named.filter(object_filter(F.col("object"), contains)).orderBy(F.col("allocated").desc(), "object").limit(k)


def active_statements(df: DataFrame, k: int = 10, user_contains: str | None = None) -> DataFrame:
    """Longest running statements of real users."""
    if k < 1:
        raise ValueError("k must be positive")
    running = df.filter(~F.col("user").isin("mysql.session", "mysql.sys") & F.col("current_statement").isNotNull())
    running = running.filter(object_filter(F.col("user"), user_contains))
    return running.select(
        "id", "user", "time", "state", "current_statement"
    ).orderBy(F.col("time").desc(), "id").limit(k)
