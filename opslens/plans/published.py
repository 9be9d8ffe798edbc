"""Folders that are published under a name: written aside first, then pointed to by one small file.

The pointers of a root are rows of ``<root>/_published``; a version is appended as one file, which Spark's commit
moves into place at once.  A reader takes the newest folder of every name, so it sees a version whole or not at all,
and a failed write leaves the older one.  One writer at a time may publish below a root.  Folders of older versions stay
for readers that still use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTERS = "version long, name string, folder string"


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """All versions ever published below ``root``; no rows before the first."""
    try:
        return spark.read.schema(_POINTERS).parquet(f"{root.rstrip('/')}/_published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _POINTERS)


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """The newest folder of every name; as many entries as there are names, not versions."""
    newest = pointers(spark, root).groupBy("name").agg(F.max_by("folder", "version").alias("folder"))
    return {r["name"]: f"{root.rstrip('/')}/{r['folder']}" for r in newest.collect()}


def new_folder() -> str:
    """A folder name below a root that nothing points to yet."""
    return f"data/{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, folders: Mapping[str, str]) -> int:
    """Point every name to its folder (relative to ``root``), all at once; the number of the new version."""
    last = pointers(spark, root).agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    rows = [(version, name, folder) for name, folder in sorted(folders.items())]
    spark.createDataFrame(rows, _POINTERS).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/_published")
    return version
