"""Reading tables, fresh column names, and results written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder from ``spark.checkpoint.dir``; an own one only where that is unset and the master local (tests)."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the frame's own columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_id(df: DataFrame, name: str = "row_id") -> tuple[DataFrame, str]:
    """A staged copy of the rows under a unique number, so that repeated and null keys stay apart."""
    column = fresh(df, name)
    return staged(df.withColumn(column, F.monotonically_increasing_id()), name), column


def with_bucketed_row_id(df: DataFrame, name: str = "row_id") -> tuple[DataFrame, str]:
    """As :func:`with_row_id`, bucketed by the number: joins on it do not shuffle the rows again."""
    spark, column, table_name = df.sparkSession, fresh(df, name), f"llm_rows_{uuid.uuid4().hex}"
    n = task_partitions(df)
    rows = df.withColumn(column, F.monotonically_increasing_id()).repartition(n, column)
    writer = rows.write.bucketBy(n, column).sortBy(column).option("compression", "zstd")
    writer.option("path", f"{shared_folder(spark)}/llm/{table_name}").saveAsTable(table_name)
    return spark.table(table_name), column


def task_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
