"""Engine status samples to incident and transaction rows.

One record is one sample, whose size the server itself limits, so a sample is taken apart inside
its row: no line has to be related to a line of another record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.bands import rows_locked_alert
from opslens.functions.statements import sql_template, sql_verb
from opslens.operators.filters import glob_filter
from opslens.plans.staging import settled

STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
STALE_S = 9000
UNKNOWN = "unknown"

_DEADLOCK = r"(?m)^LATEST DETECTED DEADLOCK.*$"
_TRANSACTIONS = r"(?m)^TRANSACTIONS.*$"
# A line of capitals ends the deadlock section unless it belongs to the report itself.
_SECTION_END = r"(?m)^(?!.*(?:TRANSACTION|WAITING|GRANTED|RECORD))[A-Z ]+$|^TRANSACTIONS"
_ENTRY = r"(?m)^(?=.*TRANSACTION \d+)"
_TRX_ID = r"TRANSACTION (\d+)(?:,|\s|$)"
_THREAD = r"MySQL thread id (\d+)"
_OWNER = r"(?m)MySQL thread id .*query id \S+ (\S+) (\S+)"
_QUERY = r"(?m)query id.*\n[ \t]*(.*)$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    value = F.regexp_extract(text, pattern, group)
    return F.when(value != "", value)


def _after(text: Column, pattern: str) -> Column:
    return F.get(F.split(text, pattern, 2), F.lit(1))


def _before(text: Column, pattern: str) -> Column:
    return F.get(F.split(text, pattern, 2), F.lit(0))


def _entry(kind: Column, ts: Column, text: Column) -> Column:
    return F.struct(
        kind.alias("type"), ts.alias("ts"), text.alias("text")
    )


def parse_engine_status(
    samples: DataFrame,
    mode: str = "all",
    tables: str | None = None,
    users: str | None = None,
    start: str | None = None,
    end: str | None = None,
    missing: str = UNKNOWN,
    literal_keywords: bool = True,
    strict_range: bool = False,
    stale_s: int = STALE_S,
) -> DataFrame:
    """Deadlock, lock-wait and (in mode ``full``) active statements of samples.

    ``samples`` has ``text`` and ``file_hour``.  A deadlock older than ``stale_s`` seconds at
    the file's hour is a leftover and is dropped.  A time that does not exist counts as not given.  ``strict_range`` applies the time range to deadlocks only.
    """
    if mode not in ("all", "deadlocks", "locks", "full"):
        raise ValueError("mode must be all, deadlocks, locks or full")
    kept = [c for c in samples.columns if c not in ("text", "file_hour")]
    text = F.col("text")
    header = F.try_to_timestamp(_found(text, rf"(?m)^.*?({STAMP}).*INNODB MONITOR OUTPUT"))
    deadlock_part = _before(_after(text, _DEADLOCK), _SECTION_END)
    trx_part = _before(_after(text, _TRANSACTIONS), r"(?m)^FILE I/O")
    staged = samples.select(
        *kept,
        F.col("file_hour").try_cast("timestamp").alias("file_hour"),
        F.coalesce(header, F.col("file_hour").try_cast("timestamp")).alias("sample_ts"),
        deadlock_part.alias("deadlock"),
        F.try_to_timestamp(_found(deadlock_part, rf"(?m)^[ \t]*({STAMP})")).alias("deadlock_ts"),
        trx_part.alias("trx"),
    )
    no_entries = F.array().cast("array<string>")
    fresh = F.col("deadlock_ts").isNotNull() & (
        F.unix_seconds("file_hour") - F.unix_seconds("deadlock_ts") <= stale_s
    )
    dead = F.when(fresh, F.split("deadlock", _ENTRY)).otherwise(no_entries)
    live = F.coalesce(F.split("trx", _ENTRY), no_entries)

    def waits(entry: Column) -> Column:
        return _before(entry, r"query id").contains("LOCK WAIT")

    groups = []
    if mode != "locks":
        groups.append(F.transform(dead, lambda e: _entry(F.lit("DEADLOCK"), F.col("deadlock_ts"), e)))
    if mode != "deadlocks":
        live_kind = lambda e: F.when(waits(e), "LOCK").otherwise("ACTIVE")
        groups.append(F.transform(live, lambda e: _entry(live_kind(e), F.col("sample_ts"), e)))
    entries = staged.select(*kept, F.explode(F.concat(*groups)).alias("e")).select(*kept, "e.type", "e.ts", "e.text")
    if mode != "full":
        entries = entries.filter(F.col("type") != "ACTIVE")
    query = F.regexp_extract("text", _QUERY, 1)
    rows = settled(entries, query=query).withColumn("op", sql_verb(F.col("query"))).filter(F.col("op").isNotNull())
    default = F.lit(missing)
    rows = rows.select(
        *kept, "type", "ts",
        F.coalesce(_found(F.col("text"), _OWNER, 2), default).alias("user"),
        F.coalesce(_found(F.col("text"), _OWNER, 1), default).alias("host"),
        F.coalesce(_found(F.col("text"), _THREAD), default).alias("thread"),
        F.coalesce(_found(F.col("text"), _TRX_ID), default).alias("trx"),
        "op", "query",
    )
    if tables:
        rows = rows.filter(glob_filter(F.col("query"), tables))
    if users:
        rows = rows.filter(glob_filter(F.col("user"), users))
    exempt = (F.col("type") != "DEADLOCK") if strict_range else F.lit(False)
    if start:
        rows = rows.filter(exempt | (F.col("ts") >= F.lit(start).cast("timestamp")))
    if end:
        rows = rows.filter(exempt | (F.col("ts") <= F.lit(end).cast("timestamp")))
    return rows.withColumn("template", sql_template(F.col("query"), literal_keywords))


def status_transactions(samples: DataFrame) -> DataFrame:
    """Transactions of every sample with their age, row locks and statement; idle ones left out."""
    kept = [c for c in samples.columns if c not in ("text", "file_hour")]
    stamp = F.try_to_timestamp(_found(F.col("text"), rf"(?m)^.*?({STAMP}).*INNODB MONITOR OUTPUT"))
    # A line of exactly eight dashes closes the list.
    listed = _before(F.col("text"), r"(?m)^--------$")
    blocks = F.slice(F.split(listed, r"(?m)^---TRANSACTION "), 2, 2_147_483_647)
    rows = samples.select(*kept, stamp.alias("sample_ts"), F.posexplode(blocks).alias("pos", "block"))
    rows = rows.filter(~F.substring_index("block", "\n", 1).contains("not started"))
    lines = F.split("block", "\n")
    head = F.get(lines, F.lit(0))
    second, third, fourth, fifth = (F.coalesce(F.get(lines, F.lit(i)), F.lit("")) for i in range(1, 5))
    in_use = second.startswith("mysql tables in use")
    prepared = head.contains("PREPARED")
    cleaning = third.endswith(" cleaning up") | third.startswith("Trx read view")
    query = (
        F.when(in_use, fifth)
        .when(prepared, fourth)
        .when(third.endswith(" init"), fourth)
        .when(cleaning, "cleaning up")
        .otherwise("")
    )
    words = F.split(head, " ")
    at = F.when(prepared, 3).otherwise(2)
    running = F.concat_ws(" ", F.get(words, at), F.get(words, at + 1))
    locked = F.coalesce(_found(F.col("block"), r"(\d+) row lock\(s\)").cast("long"), F.lit(0).cast("long"))
    return rows.select(
        *kept, "sample_ts", "pos",
        F.regexp_extract(head, r"^(\S+?),?(?: |$)", 1).alias("trx_id"),
        running.alias("running"),
        locked.alias("rows_locked"),
        rows_locked_alert(locked).alias("alert"),
        F.trim(query).alias("query"),
    )
