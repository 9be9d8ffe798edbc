"""Storage growth: projections from the catalog and stored size facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.units import type_bytes

# Page fill factor and days of a month in the projections.
PAGE_FACTOR = 1.2
MONTH_DAYS = 30
MIB = 1024.0 * 1024.0
INDEX_SHARE = 0.3


def storage_projection(
    columns: DataFrame,
    daily_rows: int,
    unit: str = "day",
    retention_days: int = 30,
    index_factor: float = INDEX_SHARE,
    pool_bytes: int = 8 * 1024**3,
    table_like: str | None = None,
    server_totals: bool = False,
) -> DataFrame:
    """Projected rows and sizes per server, schema and table, with one grand total.

    ``server_totals`` adds a total of every server.  A total is named TOTAL and has ``is_total``, which tells it from
    a table without a name or of that name; ``level`` is TABLE, SERVER or ALL.
    """
    divisor = {"day": 1, "hour": 24}[unit]
    if table_like:
        columns = columns.filter(F.col("table_name").like(table_like))
    width = type_bytes(F.col("data_type"), F.col("char_octet_length"), F.col("numeric_precision"))
    keys = ["server", "table_schema", "table_name"]
    tables = columns.groupBy(*keys).agg(F.sum(width).alias("row_bytes"))
    data_mb = F.col("row_bytes") * daily_rows * PAGE_FACTOR / MIB
    daily = tables.select(
        *keys,
        F.lit(daily_rows).cast("decimal(20,0)").alias("rows"),
        data_mb.alias("data_mb"),
        (data_mb * index_factor).alias("idx_mb"),
    )
    names = [F.col(k) for k in keys]
    sets = [names, names[:1], []] if server_totals else [names, []]
    rolled = daily.groupingSets(sets, *names).agg(
        F.grouping_id().alias("grouping"),
        F.sum("rows").alias("rows"),
        F.sum("data_mb").alias("data_mb"),
        F.sum("idx_mb").alias("idx_mb"),
    )
    both = F.col("data_mb") + F.col("idx_mb")
    is_total = F.col("grouping") != 0
    return rolled.select(
        "server",
        "table_schema",
        F.when(is_total, "TOTAL").otherwise(F.col("table_name")).alias("table_name"),
        F.when(F.col("grouping") == 0, "TABLE").when(F.col("grouping") == 3, "SERVER").otherwise("ALL").alias("level"),
        is_total.alias("is_total"),
        F.round(F.col("rows") / divisor).cast("long").alias(f"rows_{unit}"),
        (F.col("rows") * retention_days).cast("decimal(38,0)").alias("total_rows"),
        F.round(F.col("data_mb") / divisor, 4).alias(f"data_mb_{unit}"),
        F.round(F.col("idx_mb") / divisor, 4).alias(f"idx_mb_{unit}"),
        F.round(both / divisor, 4).alias(f"total_mb_{unit}"),
        F.round(both * MONTH_DAYS / 1024, 2).alias("total_gb_month"),
        F.round(both * retention_days / 1024, 2).alias("retention_gb"),
        F.round(both * retention_days * MIB / pool_bytes * 100, 2).alias("pool_pct"),
    )


def storage_projection_by_index(
    columns: DataFrame, statistics: DataFrame, daily_rows: int, retention_days: int = 30
) -> DataFrame:
    """Projection that charges a share of the data size for every secondary index."""
    keys = ["server", "table_schema", "table_name"]
    indexes = statistics.groupBy(*keys).agg((F.count_distinct("index_name") - 1).alias("secondary_indexes"))
    width = type_bytes(F.col("data_type"), F.col("char_octet_length"), F.col("numeric_precision"), "by_index")
    tables = columns.groupBy(*keys).agg(F.sum(width).alias("row_bytes"))
    n = F.coalesce(F.col("secondary_indexes"), F.lit(-1))
    base = F.col("row_bytes") * daily_rows * PAGE_FACTOR / MIB
    daily_mb = base * (1 + INDEX_SHARE * n)
    return tables.join(indexes, keys, "left").select(
        *keys,
        n.alias("secondary_indexes"),
        F.lit(daily_rows).alias("daily_rows"),
        F.round(daily_mb, 2).alias("daily_total_mb"),
        F.round(daily_mb / 1024, 2).alias("daily_total_gb"),
        F.round(daily_mb * MONTH_DAYS / 1024, 2).alias("monthly_total_gb"),
        F.round(base * (MONTH_DAYS + INDEX_SHARE * n) / 1024, 2).alias("monthly_total_gb_literal"),
        F.lit(MONTH_DAYS * daily_rows).alias("monthly_estimated_rows"),
        F.round(daily_mb * retention_days / 1024, 2).alias("total_retention_gb"),
    )


def table_sizes(facts: DataFrame) -> DataFrame:
    """Data and index size and rows per table, largest first."""
    return facts.select(
        "server",
        "table_schema",
        "table_name",
        F.round(F.col("data_bytes") / MIB, 2).alias("data_mb"),
        F.round(F.col("index_bytes") / MIB, 2).alias("index_mb"),
        "table_rows",
    ).orderBy(F.col("data_mb").desc(), F.col("index_mb").desc(), "server", "table_schema", "table_name")


def index_sizes(indexes: DataFrame, size_stats: DataFrame, page_bytes: int = 16384) -> DataFrame:
    """Size of every index from its page count; NULL where no statistic exists."""
    keys = ["server", "table_schema", "table_name", "index_name"]
    pages = size_stats.filter(F.col("stat_name") == "size").select(*keys, "stat_value")
    return indexes.select(*keys).distinct().join(pages, keys, "left").select(
        *keys, F.round(F.col("stat_value") * page_bytes / MIB, 2).alias("index_mb")
    )
