"""Severity labels.  The limits below are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_band(age: Column) -> Column:
    return F.when(age >= 300, "red").when(age >= 120, "orange").when(age >= 60, "yellow").otherwise("none")


def query_band(time_ms: Column) -> Column:
    return F.when(time_ms > 1000, "red").when(time_ms > 500, "yellow").otherwise("cyan")


def over_threshold(connections: Column, n: int) -> Column:
    return F.lit(n > 0) & (connections >= n)


def backend_band(status: Column) -> Column:
    """Band of a backend status; an unknown status counts as failed."""
    name = F.upper(F.trim(status))
    return (
        F.when(name == "ONLINE", "green")
        .when(name == "SHUNNED", "yellow")
        .when(name == "OFFLINE_SOFT", "orange")
        .otherwise("red")
    )


def ping_ok(error: Column) -> Column:
    return F.coalesce(F.upper(F.trim(error)), F.lit("")).isin("", "NULL")


def rows_locked_alert(rows: Column) -> Column:
    return F.when(rows >= 10000, "CRITICAL").when(rows >= 1000, "WARNING").otherwise("OK")


def hll_band(length: Column) -> Column:
    return F.when(length >= 500000, "red").when(length >= 100000, "yellow").otherwise("green")


def io_band(rate: Column) -> Column:
    return F.when(rate > 5000, "red").when(rate > 0, "yellow").otherwise("none")


def episode_severity(max_duration: Column) -> Column:
    return F.when(max_duration >= 60, "HIGH").when(max_duration >= 30, "MEDIUM").otherwise("LOW")


# Resize stages of the buffer pool by status code.
RESIZE_STAGES = {
    0: "No resize in progress",
    1: "Starting resize",
    2: "Disabling AHI",
    3: "Withdrawing blocks",
    4: "Acquiring global lock",
    5: "Resizing pool",
    6: "Resizing hash",
    7: "Resize failed",
}


def resize_stage(code: Column) -> Column:
    label = F.lit("Numeric resize status unavailable")
    for number, name in RESIZE_STAGES.items():
        label = F.when(code.cast("string") == str(number), name).otherwise(label)
    return label


def resize_progress(code: Column, progress: Column) -> Column:
    """Percent done, at most 100; ``N/A`` unless both values are usable numbers."""
    usable = code.cast("string").rlike("^[0-7]$") & progress.cast("string").rlike("^[0-9]+$")
    value = F.least(progress.cast("string").try_cast("decimal(38,0)"), F.lit(100).cast("decimal(38,0)"))
    return F.when(usable, value.cast("string")).otherwise("N/A")
