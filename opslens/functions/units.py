"""Numbers, sizes and times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, scale: int) -> Column:
    """``a / b`` of whole numbers rounded half up; NULL when ``b`` is zero or missing."""
    wide = "decimal(20,0)"
    return F.round(F.try_divide(a.cast(wide), b.cast(wide)), scale).cast("double")


def safe_percent(a: Column, b: Column, scale: int = 2) -> Column:
    wide = "decimal(20,0)"
    return F.round(F.try_divide(a.cast(wide) * 100, b.cast(wide)), scale).cast("double")


def ps_to_seconds(ps: Column, scale: int = 3) -> Column:
    return F.round(ps.cast("decimal(20,0)") / F.lit(10**12).cast("decimal(13,0)"), scale).cast("double")


def ps_to_timestamp(ps: Column, boot_ts: Column) -> Column:
    """Timer value, counted from server start, as a point in time."""
    started = F.unix_micros(boot_ts.cast("timestamp"))
    return F.timestamp_micros((started + F.floor(ps.cast("decimal(20,0)") / 1_000_000)).cast("long"))


def work_progress(completed: Column, estimated: Column) -> Column:
    """Percent of the estimated work that is done."""
    return safe_percent(completed, estimated, 2)


def us_to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long"))


def human_bytes(size: Column) -> Column:
    """Size in the largest binary unit below 1024, two decimals (ties to even) except for plain bytes."""
    value = size.cast("double")
    text = F.format_string("%.0f B", value)
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        limit = float(1024**power)
        text = F.when(value >= limit, F.format_string(f"%.2f {unit}", F.bround(value / limit, 2))).otherwise(text)
    return F.when(size.isNotNull(), text)


def product(*factors: Column) -> Column:
    """Product of whole numbers as a double, rounded once up to 37 digits; a long product may overflow.

    A rough product of sizes decides which type holds it, as a caught overflow costs more than the whole row.
    """
    times = lambda kind: reduce(lambda a, b: a * b, [f.cast(kind) for f in factors]).cast("double")
    most = reduce(lambda a, b: a * b, [F.greatest(F.abs(f.cast("double")), F.lit(1.0)) for f in factors])
    return F.when(most < 2.0**62, times("long")).when(most < 1e37, times("decimal(19,0)")).otherwise(times("double"))


def bucket(ts: Column, unit: str) -> Column:
    """Text label of the hour, day or month of a timestamp."""
    patterns = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM", "minute": "yyyy-MM-dd HH:mm"}
    return F.date_format(ts, patterns[unit])


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole elapsed seconds, cut towards zero."""
    return F.timestamp_diff("SECOND", start.cast("timestamp"), end.cast("timestamp"))


# Bytes per value by data type, for the projection that multiplies by daily rows.
PROJECTION_BYTES = {
    "tinyint": 1, "bool": 1, "boolean": 1, "smallint": 2, "mediumint": 3, "int": 4, "bigint": 8,
    "float": 4, "double": 8, "date": 3, "datetime": 8, "timestamp": 8, "time": 3, "year": 1,
}
# Bytes per value by data type, for the projection by number of indexes.
BY_INDEX_BYTES = {"tinyint": 1, "bool": 1, "smallint": 2, "int": 4, "bigint": 8, "datetime": 8, "timestamp": 8}
BY_INDEX_TEXT_BYTES = {"tinytext": 255, "text": 1000, "mediumtext": 5000, "longtext": 10000}


def type_bytes(data_type: Column, octet_len: Column, precision: Column, variant: str = "projection") -> Column:
    """Estimated bytes of one value of a column."""
    kind = F.lower(data_type)

    def fixed(table: dict[str, int]) -> Column:
        size = F.lit(None).cast("double")
        for name, width in table.items():
            size = F.when(kind == name, F.lit(float(width))).otherwise(size)
        return size

    if variant == "projection":
        special = (
            F.when(kind == "decimal", precision / 2 + 1)
            .when(kind.isin("char", "varchar", "binary", "varbinary"), octet_len.cast("double"))
            .when(
                kind.contains("text") | kind.contains("blob") | kind.isin("json", "geometry", "point"),
                F.lit(1024.0),
            )
            .otherwise(F.lit(8.0))
        )
        return F.coalesce(fixed(PROJECTION_BYTES), special)
    if variant == "by_index":
        sized_text = F.when(octet_len.isNotNull() & ~kind.contains("text"), octet_len.cast("double"))
        return F.coalesce(fixed(BY_INDEX_BYTES), sized_text, fixed(BY_INDEX_TEXT_BYTES), F.lit(8.0))
    raise ValueError("variant must be 'projection' or 'by_index'")
