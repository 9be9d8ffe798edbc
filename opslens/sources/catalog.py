"""Catalog metadata: columns, statistics, primary and foreign keys, and a Spark dataset's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.plans.staging import hashed
from opslens.schemas import schema
from opslens.sources.snapshots import read_snapshot


def catalog_columns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_snapshot(spark, "catalog_columns", path, fmt)


def catalog_statistics(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_snapshot(spark, "catalog_statistics", path, fmt)


def _of_constraint(usage: DataFrame, constraints: DataFrame, keys: list[str]) -> DataFrame:
    return hashed(usage, keys, "__key").join(hashed(constraints, keys, "__key"), ["__key", *keys])


def catalog_primary_keys(usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Primary key columns from the key usage and the constraint types."""
    keys = ["server", "constraint_schema", "table_name", "constraint_name"]
    primary = constraints.filter(F.col("constraint_type") == "PRIMARY KEY").select(*keys)
    return _of_constraint(usage, primary, keys).select("server", "constraint_schema", "table_name", "column_name", "ordinal")


def catalog_foreign_keys(usage: DataFrame, referential: DataFrame) -> DataFrame:
    """Foreign key columns with the rules of their constraint."""
    keys = ["server", "constraint_schema", "table_name", "constraint_name"]
    pointing = usage.filter(F.col("ref_table").isNotNull())
    return _of_constraint(pointing, referential.select(*keys, "update_rule", "delete_rule"), keys).select(
        "server", "constraint_name", "constraint_schema", "table_name", "column_name",
        "ref_schema", "ref_table", "ref_column", "ordinal", "update_rule", "delete_rule",
    )


def _catalog_type(data_type: T.DataType) -> tuple[str, str, int | None, int | None]:
    """Column type, data type, octet length and precision as a catalog names them."""
    if isinstance(data_type, T.DecimalType):
        return f"decimal({data_type.precision},{data_type.scale})", "decimal", None, data_type.precision
    names = {
        T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint",
        T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "tinyint", T.DateType: "date",
        T.TimestampType: "timestamp", T.TimestampNTZType: "datetime", T.StringType: "text", T.BinaryType: "blob",
    }
    name = names.get(type(data_type), "json")
    return name, name, None, None


def catalog_from_df(df: DataFrame, db: str, name: str, server: str = "spark") -> DataFrame:
    """Catalog rows of a Spark dataset, one per column."""
    rows = []
    for i, field in enumerate(df.schema.fields, start=1):
        column_type, data_type, octets, precision = _catalog_type(field.dataType)
        text = isinstance(field.dataType, T.StringType)
        rows.append(
            (
                server, db, name, field.name, i, column_type, data_type, "YES" if field.nullable else "NO",
                octets, precision, "utf8mb4" if text else None, "utf8mb4_bin" if text else None,
            )
        )
    return df.sparkSession.createDataFrame(rows, schema("catalog_columns"))


def table_list(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """Table names of a list file, without blanks, comments and repeats."""
    lines = spark.read.text(path).select(F.trim("value").alias("table_name"))
    if extra:
        lines = lines.unionByName(spark.createDataFrame([(t.strip(),) for t in extra], "table_name string"))
    kept = lines.filter((F.col("table_name") != "") & ~F.col("table_name").startswith("#"))
    return kept.distinct().orderBy("table_name")
