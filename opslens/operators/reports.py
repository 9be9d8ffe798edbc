"""Report output: CSV / TSV datasets published as a whole, and the incident report set."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from opslens.operators.incidents import (
    contention_score, incidents, lock_seconds, operations_overview, participants, participants_of_all, query_recap,
)
from opslens.operators.timeline import op_time_series
from opslens.plans.published import new_folder, publish, published
from opslens.session import checkpointed


def report_format(path: str, fmt: str | None = None) -> str:
    """TSV for a ``.tsv`` name, CSV otherwise."""
    fmt = fmt or ("tsv" if path.lower().endswith(".tsv") else "csv")
    if fmt not in ("csv", "tsv"):
        raise ValueError("format must be csv or tsv")
    return fmt


def write_report(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Write a report dataset with header and quoted fields.

    The report is written beside its place first and swapped in by renames, so a failed write
    leaves the old report as it was.  Between the renames there is none: :func:`publish_report` has no such moment.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tag = uuid.uuid4().hex
    staging = f"{path.rstrip('/')}.{tag}.new"
    _csv(df, staging, report_format(path, fmt))
    previous = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{tag}.old")
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, previous):
        raise OSError(f"cannot move the old report at {path}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        if replaced:
            fs.rename(previous, target)
        raise OSError(f"cannot publish the report at {path}")
    if replaced:
        fs.delete(previous, True)


REPORT = "report"


def _csv(df: DataFrame, path: str, fmt: str) -> None:
    separator = "\t" if fmt == "tsv" else ","
    writer = df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("sep", separator)
    # Blanks at the ends of a value are part of it.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _written(df: DataFrame, root: str, fmt: str) -> str:
    folder = new_folder()
    _csv(df, f"{root.rstrip('/')}/{folder}", fmt)
    return folder


def publish_report(df: DataFrame, root: str, fmt: str | None = None) -> None:
    """Write a report below ``root`` and point to it.

    A reader that asks :func:`report_folder` finds a whole report at any time: the old one until the new one is
    complete, and the old one still after a failed write.
    """
    publish(df.sparkSession, root, {REPORT: _written(df, root, report_format(root, fmt))})


def report_folder(spark: SparkSession, root: str, name: str = REPORT) -> str:
    """The folder that holds the report last published below ``root``."""
    return published(spark, root)[name]


def incident_reports(rows: DataFrame, unit: str = "day", per: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All incident reports over extracted rows: detail, recaps, operations, series, contention.

    ``per`` (the file, say) adds a recap of every group.  The participants and the lock seconds are found once: several
    reports read them, and each of them several times.
    """
    firsts = checkpointed(participants(rows, per), "participants")
    whole = checkpointed(participants_of_all(firsts), "participants") if per else firsts
    locks = checkpointed(lock_seconds(rows), "lock-seconds")
    detail = rows.select(*per, "type", "ts", "user", "host", "thread", "trx", "template")
    reports = {
        "detail": detail,
        "recap": incidents(rows, firsts=whole, locks=locks),
        "query_recap": query_recap(rows),
        "operations": operations_overview(rows),
        "time_series": op_time_series(rows, unit),
        "contention": contention_score(rows, locks=locks),
    }
    if per:
        reports[f"recap_per_{'_'.join(per)}"] = incidents(rows, per=per, firsts=firsts)
    return reports


def write_incident_reports(rows: DataFrame, path: str, unit: str = "day", fmt: str = "csv", per: Sequence[str] = ()) -> None:
    """All reports below ``path``, published together; the rows are extracted once, however many reports read them."""
    staged = checkpointed(rows, "report-rows")
    folders = {name: _written(frame, path, report_format(path, fmt)) for name, frame in incident_reports(staged, unit, per).items()}
    publish(rows.sparkSession, path, folders)
