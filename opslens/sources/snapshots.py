"""Stored snapshots as DataFrames or streams, each with its declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from opslens.schemas import schema


def read_snapshot(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A stored relation; the schema is declared, so nothing is scanned to infer it."""
    reader = spark.read.schema(schema(name)).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("nullValue", "\\N")
    return reader.options(**options).load(path)


def read_live(spark: SparkSession, name: str, url: str, query_table: str, predicates: Sequence[str], properties: dict) -> DataFrame:
    """A relation of a running server over JDBC, one task per predicate (such as one per schema)."""
    frame = spark.read.jdbc(url, query_table, predicates=list(predicates), properties=properties)
    wanted = [f.name for f in schema(name).fields if f.name in frame.columns]
    return frame.select(*wanted)


def _reader(name: str):
    def read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
        return read_snapshot(spark, name, path, fmt, **options)

    read.__name__ = name
    read.__doc__ = f"Stored ``{name}`` rows."
    return read


sessions = _reader("sessions")
transactions = _reader("transactions")
threads = _reader("threads")
trx_events = _reader("trx_events")
statements = _reader("statements")
lock_waits = _reader("lock_waits")
locks = _reader("locks")
counters = _reader("counters")
proxy_sessions = _reader("proxy_sessions")
proxy_digests = _reader("proxy_digests")
proxy_pool = _reader("proxy_pool")
proxy_pings = _reader("proxy_pings")
pool_stats = _reader("pool_stats")
buffer_pages = _reader("buffer_pages")
buffer_tables = _reader("buffer_tables")
table_sizes = _reader("table_sizes")
catalog_objects = _reader("catalog_objects")
privileges = _reader("privileges")


def doc_ops(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """Document-store operation snapshots, one JSON document per line."""
    return read_snapshot(spark, "doc_ops", path, fmt, **options)
