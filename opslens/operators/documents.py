"""Document-store operation snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.documents import namespace_db


def doc_summary(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Connections, running time and operation / database counts per application.

    Counts per (application, operation) and per (application, database) are formed first, so the
    maps are built from one row per entry.
    """
    keys = [*per, "app"]
    active = df.filter(F.col("active") & (F.col("desc") != "conn")).select(
        *per,
        F.when(F.col("appName") != "", F.col("appName")).otherwise("Unknown").alias("app"),
        "op",
        F.when(F.col("ns") != "", namespace_db(F.col("ns"))).alias("db"),
        F.coalesce("secs_running", F.lit(0)).alias("secs"),
    )
    cells = active.groupBy(*keys, "op", "db").agg(F.count(F.lit(1)).alias("n"), F.sum("secs").alias("secs"))
    entries = cells.select(
        *keys, "secs", "n",
        F.explode(
            F.array(
                F.struct(F.lit("op").alias("kind"), F.col("op").alias("name")),
                F.struct(F.lit("db").alias("kind"), F.col("db").alias("name")),
            )
        ).alias("e"),
    )
    named = entries.groupBy(*keys, F.col("e.kind").alias("kind"), F.col("e.name").alias("name")).agg(
        F.sum("n").alias("n"), F.sum("secs").alias("secs")
    )

    def counts(kind: str):
        pairs = F.collect_list(F.when((F.col("kind") == kind) & F.col("name").isNotNull(), F.struct("name", "n")))
        return F.map_from_entries(F.array_sort(pairs))

    on_op = F.col("kind") == "op"
    return named.groupBy(*keys).agg(
        F.sum(F.when(on_op, F.col("n"))).alias("total_connections"),
        F.sum(F.when(on_op, F.col("secs"))).alias("total_running_secs"),
        F.round(F.sum(F.when(on_op, F.col("secs"))) / F.sum(F.when(on_op, F.col("n"))), 2).alias("avg_secs"),
        counts("op").alias("operations"),
        counts("db").alias("databases"),
    )


def doc_by_runtime(df: DataFrame, k: int) -> DataFrame:
    """Longest running operations with their rank."""
    shown = df.filter(F.col("active") & (F.col("desc") != "conn") & F.col("secs_running").isNotNull())
    ordered = [F.col("secs_running").desc(), F.col("connectionId")]
    top = shown.orderBy(*ordered).limit(k)
    # The rank is taken over the k rows that are left.
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ordered))).select(
        "rank", "connectionId", "client",
        F.coalesce(F.when(F.col("appName") != "", F.col("appName")), F.lit("Unknown")).alias("app"),
        F.coalesce(F.when(F.col("ns") != "", F.col("ns")), F.lit("N/A")).alias("ns"),
        "op", "secs_running",
    )
