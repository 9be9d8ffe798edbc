"""Deadlock, lock-wait and statement statistics over extracted incident rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.statements import template_hash
from opslens.functions.text import first_mentioned, first_n
from opslens.functions.units import safe_percent
from opslens.operators.timeline import lock_episodes, top_k
from opslens.plans.ordered import micros

DEADLOCK_WEIGHT = 30
KEYS = ["type", "template"]


def dedupe_incidents(df: DataFrame) -> DataFrame:
    """Identical rows reported by overlapping samples count once."""
    return df.dropDuplicates(["type", "ts", "user", "host", "thread", "trx", "template"])


def lock_seconds(df: DataFrame, gap_s: float = 15, per: Sequence[str] = ()) -> DataFrame:
    """Total length of the lock episodes of every template (of each ``per`` group)."""
    episodes = lock_episodes(df.filter(F.col("type") == "LOCK"), [*per, "template"], "ts", gap_s)
    return episodes.groupBy(*per, "template").agg(
        F.sum("duration_s").cast("long").alias("lock_seconds"), F.count(F.lit(1)).alias("episodes")
    )


def participants(df: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Every user, host, thread and transaction of an incident kind with the time it was first seen."""
    keys = [*per, *KEYS]
    dims = ("user", "host", "thread", "trx")
    # Rows that differ in nothing else are one before they are unfolded.
    seen = df.groupBy(*keys, *dims).agg(F.min("ts").alias("ts"))
    unfolded = seen.select(
        *keys, "ts", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("item")) for d in dims])).alias("e")
    ).select(*keys, "ts", "e.dim", "e.item")
    return unfolded.groupBy(*keys, "dim", "item").agg(F.min("ts").alias("first"))


def participants_of_all(firsts: DataFrame) -> DataFrame:
    """:func:`participants` of all groups together, from those of every group."""
    return firsts.groupBy(*KEYS, "dim", "item").agg(F.min("first").alias("first"))


def _short_lists(firsts: DataFrame, n: int, per: Sequence[str]) -> DataFrame:
    """First-seen order of users, threads and transactions per incident kind, as short lists."""
    keys = [*per, *KEYS]
    counts = firsts.groupBy(*keys, "dim").agg(F.count(F.lit(1)).alias("items"))
    # Threads and transactions are unbounded; only n of them per group leave a task.
    many = firsts.filter(F.col("dim").isin("thread", "trx"))
    few = firsts.filter(F.col("dim").isin("user", "host"))
    order = [F.col("first"), F.col("item")]
    head = top_k(many, n, order, [*keys, "dim"]).drop("rank").unionByName(few)
    lists = head.groupBy(*keys, "dim").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "item"))), lambda x: x["item"]).alias("shown")
    )
    joined = lists.join(counts, [*keys, "dim"])

    def of(dim: str, text: Column) -> Column:
        return F.max(F.when(F.col("dim") == dim, text))

    return joined.groupBy(*keys).agg(
        of("user", F.array_join("shown", ", ")).alias("users"),
        of("host", F.array_join("shown", ", ")).alias("hosts"),
        of("thread", first_n(F.col("shown"), n, F.col("items"))).alias("threads"),
        of("trx", first_n(F.col("shown"), n, F.col("items"))).alias("trxs"),
    )


def incidents(
    df: DataFrame, gap_s: float = 15, list_n: int = 3, per: Sequence[str] = (),
    firsts: DataFrame | None = None, locks: DataFrame | None = None,
) -> DataFrame:
    """One row per incident type and template: counts, span, participants and lock seconds.

    ``per`` (the file, say) gives every group its own summary.  The lists name the first ``list_n`` threads and
    transactions; :func:`participants` has them all.  ``firsts`` and ``locks`` are the results of :func:`participants`
    and :func:`lock_seconds` where these have been written for other reports too.
    """
    firsts = participants(df, per) if firsts is None else firsts
    locks = lock_seconds(df, gap_s, per) if locks is None else locks
    keys = [*per, *KEYS]
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    locked = locks.select(*per, F.lit("LOCK").alias("type"), "template", "lock_seconds")
    return (
        totals.join(_short_lists(firsts, list_n, per), keys)
        .join(locked, keys, "left")
        .withColumn("lock_seconds", F.coalesce("lock_seconds", F.lit(0)))
        .withColumn("template_hash", template_hash(F.col("template")))
    )


def top_incidents(summary: DataFrame, top: int = 20) -> DataFrame:
    """Most frequent deadlocks and longest lock waits."""
    weight = F.when(F.col("type") == "DEADLOCK", F.col("occurrences")).otherwise(F.col("lock_seconds"))
    return top_k(summary, top, [weight.desc(), F.col("template")], ["type"])


def contention_score(df: DataFrame, gap_s: float = 15, locks: DataFrame | None = None) -> DataFrame:
    """Lock seconds plus a fixed weight per deadlock, per template; ``locks`` as in :func:`incidents`."""
    locks = lock_seconds(df, gap_s) if locks is None else locks
    counts = df.groupBy("template").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("type") == "DEADLOCK").alias("deadlocks")
    )
    seconds = F.coalesce(F.col("lock_seconds"), F.lit(0))
    return counts.join(locks, "template", "left").select(
        "template",
        (seconds + F.col("deadlocks") * DEADLOCK_WEIGHT).alias("score"),
        seconds.alias("lock_seconds"),
        "deadlocks",
        "occurrences",
    )


def _span_minutes(lo: Column, hi: Column) -> Column:
    return F.greatest((micros(hi) - micros(lo)) / 60_000_000, F.lit(1.0))


def operations_overview(df: DataFrame, tables: Sequence[str] | None = None, text: str = "query") -> DataFrame:
    """Statements per verb: share, rate over the whole span, deadlocks and locks; with total rows.

    With ``tables`` the counts are split by the first listed table a statement mentions.  After the
    aggregation only one row per table and verb is left, which the span and shares are taken from.
    """
    table = first_mentioned(F.col(text), list(tables)) if tables else F.lit("GLOBAL")
    cells = df.groupBy(table.alias("table_name"), "op").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("type") == "DEADLOCK").alias("deadlocks"),
        F.count_if(F.col("type") == "LOCK").alias("locks"),
        F.min("ts").alias("lo"),
        F.max("ts").alias("hi"),
    )
    rolled = cells.rollup("table_name", "op").agg(
        F.grouping("table_name").alias("g_table"), F.grouping("op").alias("g_op"),
        *[F.sum(c).alias(c) for c in ("total", "deadlocks", "locks")], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    everything = Window.partitionBy(F.lit(0))
    of_table = Window.partitionBy("table_name", "g_table")
    minutes = _span_minutes(F.min("lo").over(everything), F.max("hi").over(everything))
    whole = F.max("total").over(of_table)
    out = rolled.select(
        F.when(F.col("g_table") == 1, "ALL").otherwise(F.col("table_name")).alias("table_name"),
        F.when(F.col("g_op") == 1, "TOTAL").otherwise(F.coalesce("op", F.lit("OTHER"))).alias("op"),
        "total",
        safe_percent(F.col("total"), whole).alias("pct"),
        F.round(F.col("total") / minutes, 2).alias("ops_per_min"),
        "deadlocks",
        "locks",
        "g_table",
    )
    if tables is None:
        return out.filter("g_table = 0").drop("table_name", "g_table")
    return out.drop("g_table")


def query_recap(df: DataFrame) -> DataFrame:
    """Occurrences and rate of every template over its own span."""
    spans = df.groupBy("template").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    rate = F.round(F.col("occurrences") / _span_minutes(F.col("first_seen"), F.col("last_seen")), 2)
    return spans.withColumn("ops_per_min", rate)
