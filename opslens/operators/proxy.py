"""Proxy statistics: connections, running queries, digests, pool and pings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.bands import backend_band, ping_ok, query_band
from opslens.functions.text import sanitize_text
from opslens.functions.units import us_to_timestamp
from opslens.operators.filters import exclude_users
from opslens.plans.staging import settled

# Accounts of the proxy itself.
PROXY_USERS = ("admin", "radmin", "monitor", "proxysql")


def proxy_connections(
    df: DataFrame, sort: str | None = None, totals: bool = True, users: Sequence[str] = PROXY_USERS
) -> DataFrame:
    """Connections per user, client, backend and schema, with a totals row.

    Groups are formed on the raw values; ``N/A`` is only how a missing one is shown.
    """
    keys = ["user", "cli_host", "srv_host", "db"]
    sets = [[F.col(k) for k in keys]] + ([[]] if totals else [])
    counted = (
        exclude_users(df, users)
        .groupingSets(sets, *[F.col(k) for k in keys])
        .agg(F.grouping("user").alias("is_total"), F.count(F.lit(1)).alias("connections"))
    )
    total = F.col("is_total") == 1
    out = counted.select(
        F.when(total, "GLOBAL TOTALS").otherwise(F.col("user")).alias("user"),
        F.when(total, "").otherwise(F.col("cli_host")).alias("cli_host"),
        F.when(total, "").otherwise(F.coalesce("srv_host", F.lit("N/A"))).alias("srv_host"),
        F.when(total, "").otherwise(F.coalesce("db", F.lit("N/A"))).alias("db"),
        total.alias("is_total"),
        "connections",
    )
    if sort == "count":
        return out.orderBy("is_total", F.col("connections").desc(), "user", "cli_host", "srv_host", "db")
    if sort == "user":
        return out.orderBy("is_total", "user", "cli_host", "srv_host", "db")
    return out


def active_queries(df: DataFrame, users: Sequence[str] = PROXY_USERS) -> DataFrame:
    """Running statements with their severity."""
    running = exclude_users(df, users).filter(F.col("info").isNotNull() & (F.col("info") != ""))
    return running.select(
        "session_id", "hostgroup", "user", "cli_host",
        F.coalesce("srv_host", F.lit("Pending")).alias("srv_host"),
        "time_ms",
        sanitize_text(F.col("info")).alias("query"),
        query_band(F.col("time_ms")).alias("band"),
    )


def digest(df: DataFrame, text: Column, time: Column, percentiles: Sequence[float] = ()) -> DataFrame:
    """Count and times per normalised statement text; ``percentiles`` adds an array of the times' percentiles.

    Percentiles come from a sketch that every task makes of its rows, so a frequent statement is not sorted.
    """
    more = [F.percentile_approx("t", list(percentiles)).alias("percentile_times")] if percentiles else []
    return (
        settled(df.select(time.alias("t"), text.alias("__text")), digest_text=F.col("__text"))
        .groupBy("digest_text")
        .agg(
            *more,
            F.count(F.lit(1)).alias("count_star"),
            F.sum("t").alias("sum_time"),
            F.min("t").alias("min_time"),
            F.max("t").alias("max_time"),
        )
        .withColumn("digest", F.concat(F.lit("0x"), F.upper(F.substring(F.md5(F.col("digest_text").cast("binary")), 1, 16))))
    )


def digest_top(df: DataFrame, k: int = 15) -> DataFrame:
    return df.orderBy(F.col("sum_time").desc(), "digest").limit(k)


def pool_status(df: DataFrame) -> DataFrame:
    return df.withColumn("band", backend_band(F.col("status"))).orderBy("hostgroup", "srv_host")


def recent_pings(df: DataFrame, n: int = 8, per_server: bool = True) -> DataFrame:
    """Latest pings, of every server or overall; only ``n`` rows per server reach a shuffle."""
    newest = [F.col("time_start_us").desc(), F.col("hostname")]
    if per_server:
        rank = F.row_number().over(Window.partitionBy("server").orderBy(*newest))
        df = df.withColumn("rn", rank).filter(F.col("rn") <= n).drop("rn")
    else:
        df = df.orderBy(*newest).limit(n)
    return df.select(
        "server", "hostname", us_to_timestamp(F.col("time_start_us")).alias("last_ping"),
        "ping_success_time_us", "ping_error", ping_ok(F.col("ping_error")).alias("ok"),
    )
