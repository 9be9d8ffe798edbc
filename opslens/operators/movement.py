"""Data movement: upserts, archiving, partition layout, change sets, retention and audits."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from opslens.functions.text import sql_literal
from opslens.plans.published import new_folder, publish, published
from opslens.session import checkpointed


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target with the updates' rows in place of rows with the same key; the last update by ``order`` wins.

    Untouched target rows only pass an anti-join; the latest update per key is a partial
    aggregation, so many updates of one key do not meet in one task.
    """
    values = [c for c in target.columns if c not in keys]
    packed = F.max_by(F.struct(*values), F.struct(*order))
    latest = updates.groupBy(*keys).agg(packed.alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
    kept = target.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest.select(*target.columns))


BUCKET = "__bucket"


def read_target(spark: SparkSession, root: str, schema: StructType, names: Sequence[str] | None = None) -> DataFrame:
    """The rows of a bucketed target as last published (of some buckets only with ``names``)."""
    folders = published(spark, root)
    paths = [path for name, path in sorted(folders.items()) if names is None or name in names]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_into(spark: SparkSession, root: str, updates: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> list[str]:
    """Upsert into a target of ``buckets`` folders by key hash; the names of the buckets that were written anew.

    Of the updates of one key the last by ``order`` counts, and of those that agree there the largest by the other
    columns, so the result does not depend on how the updates come.  Only buckets in which a row changes are rewritten,
    beside the old ones, and all of them are published at once: a second run of the same updates changes nothing.
    """
    values = [c for c in updates.columns if c not in keys]
    by = [*order, *[c for c in values if c not in order]]
    schema = StructType([StructField(f.name, f.dataType) for f in updates.schema])
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*by)).alias("v"))
    latest = latest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values]).select(*updates.columns)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
    incoming = checkpointed(latest.withColumn(BUCKET, bucket), "merge")
    touched = [r[0] for r in incoming.select(BUCKET).distinct().collect()]
    old = read_target(spark, root, schema, touched).withColumn(BUCKET, bucket)
    same = [incoming[c].eqNullSafe(old[c]) for c in updates.columns]
    changed = incoming.join(old, functools.reduce(lambda a, b: a & b, same), "left_anti")
    names = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())
    if not names:
        return []
    new = upsert(old.filter(F.col(BUCKET).isin(names)), incoming.filter(F.col(BUCKET).isin(names)), keys, by)
    folder = new_folder()
    new.repartition(len(names), BUCKET).write.partitionBy(BUCKET).parquet(f"{root.rstrip('/')}/{folder}")
    publish(spark, root, {name: f"{folder}/{BUCKET}={name}" for name in names})
    return names


def month_chunks(df: DataFrame, ts: str, key: str, start: str, end: str) -> DataFrame:
    """Time and key range and row count per month in [start, end)."""
    inside = df.filter((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    return inside.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.min(ts).alias("first_ts"), F.min(key).alias("first_id"),
        F.max(ts).alias("last_ts"), F.max(key).alias("last_id"),
        F.count(key).alias("rows"),
    )


def archive_range(src: DataFrame, dest: DataFrame, ts: str, key: str, start: str, end: str, order: Sequence[str] = ()) -> DataFrame:
    """Destination after copying the rows of every month's key range, replacing equal keys.

    The key ranges are those of :func:`month_chunks`; they are few (one per month), so their ranges
    are applied as a filter and the source is left as it is.  Of rows with one key the last by ``order`` counts
    (by ``ts`` if none is given), and of those that agree there the largest by the other columns.
    """
    others = [c for c in dest.columns if c != key and c not in order]
    return upsert(dest, src.filter(_archived(src, ts, key, start, end)), [key], [*(order or [ts]), *others])


def _archived(src: DataFrame, ts: str, key: str, start: str, end: str) -> Column:
    chunks = month_chunks(src, ts, key, start, end).select("first_id", "last_id").collect()
    inside = F.lit(False)
    for chunk in chunks:
        inside = inside | F.col(key).between(chunk["first_id"], chunk["last_id"])
    return inside


def archive_into(
    spark: SparkSession, src: DataFrame, root: str, ts: str, key: str, start: str, end: str, order: Sequence[str] = (), buckets: int = 64
) -> list[str]:
    """:func:`archive_range` with a published target in place of a destination frame; a repeated run changes nothing."""
    return merge_into(spark, root, src.filter(_archived(src, ts, key, start, end)), [key], order or [ts], buckets)


def partition_plan(spark, start: str, n: int, unit: str = "month") -> DataFrame:
    """Range partitions: name and exclusive upper bound, named after the period they hold."""
    pattern = {"day": "yyyyMMdd", "month": "yyyyMM", "year": "yyyy"}[unit]
    step = F.expr(f"interval 1 {unit}")
    first = F.date_trunc(unit, F.lit(start).cast("timestamp_ntz"))
    periods = spark.range(1).select(
        F.explode(F.sequence(first, first + F.expr(f"interval {n - 1} {unit}"), step)).alias("from_ts")
    )
    return periods.select(
        F.concat(F.lit("p"), F.date_format("from_ts", pattern)).alias("name"),
        F.col("from_ts").cast("date").alias("from_date"),
        (F.col("from_ts") + step).cast("date").alias("less_than"),
    )


def partition_key(ts: Column, unit: str = "month") -> Column:
    pattern = {"day": "yyyyMMdd", "month": "yyyyMM", "year": "yyyy"}[unit]
    return F.concat(F.lit("p"), F.date_format(ts, pattern))


def write_partitioned(df: DataFrame, path: str, ts: str, unit: str = "month", files_per_partition: int = 16) -> None:
    """Write one folder per period; a period's rows are spread over several tasks and files."""
    keyed = df.withColumn("part", partition_key(F.col(ts), unit))
    spread = keyed.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition)))
    (
        spread.repartition("part", "__salt").drop("__salt").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    )


def change_set(df: DataFrame, op: str, table: str, key: str, cols: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Rendered INSERT IGNORE / UPDATE / DELETE statement per row.

    The first column of ``cols`` holds the key value, as in the source file of a bulk change.
    """
    types = types or dict(df.dtypes)
    literal = {c: sql_literal(F.col(c).cast("string"), _sql_kind(types[c])) for c in cols}
    where = F.concat(F.lit(f" WHERE {key} = "), literal[cols[0]], F.lit(";"))
    if op == "INSERT":
        values = F.concat_ws(", ", *[literal[c] for c in cols])
        text = F.concat(F.lit(f"INSERT IGNORE INTO {table} ({','.join(cols)}) VALUES ("), values, F.lit(");"))
    elif op == "UPDATE":
        pairs = [F.concat(F.lit(f"{c} = "), literal[c]) for c in cols[1:]]
        text = F.concat(F.lit(f"UPDATE {table} SET "), F.concat_ws(", ", *pairs), where)
    elif op == "DELETE":
        text = F.concat(F.lit(f"DELETE FROM {table}"), where)
    else:
        raise ValueError("op must be INSERT, UPDATE or DELETE")
    return df.select(F.lit(op).alias("op"), F.col(cols[0]).alias("key"), text.alias("statement"))


def _sql_kind(spark_type: str) -> str:
    return "varchar" if spark_type in ("string", "date", "timestamp", "timestamp_ntz", "boolean") else "bigint int double decimal"


def row_key(pks: DataFrame, stats: DataFrame) -> DataFrame:
    """Column to address rows by: first primary key column, else first unique index column."""
    keys = ["server", "table_schema", "table_name"]
    primary = pks.select(
        "server", F.col("constraint_schema").alias("table_schema"), "table_name",
        F.lit(1).alias("rank"), F.lit("PRIMARY").alias("index_name"), F.col("ordinal").alias("pos"), "column_name",
    )
    unique = stats.filter("non_unique = 0").select(
        *keys, F.lit(2).alias("rank"), "index_name", F.col("seq_in_index").alias("pos"), "column_name"
    )
    first = F.min(F.struct("rank", "index_name", "pos", "column_name"))
    return primary.unionByName(unique).groupBy(*keys).agg(first.alias("k")).select(
        *keys, F.col("k.column_name").alias("key_column"), F.col("k.index_name").alias("key_index")
    )


def delete_range(df: DataFrame, key: str, start: int, n: int) -> DataFrame:
    """Rows that stay after deleting ``n`` keys from ``start`` on."""
    return df.filter(F.col(key).isNull() | ~F.col(key).between(start, start + n - 1))


def split_range(df: DataFrame, key: str, start: int, n: int, workers: int) -> DataFrame:
    """Key range of each delete worker, clipped to the keys that exist; the first ones take the rest."""
    bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    lo = F.greatest(F.lit(start).cast("long"), F.col("lo"))
    hi = F.least(F.lit(start + n - 1).cast("long"), F.col("hi"))
    ranged = bounds.select(lo.alias("lo"), hi.alias("hi")).filter("hi >= lo").withColumn("n", F.expr("hi - lo + 1"))
    share, rest = F.expr(f"n div {workers}"), F.expr(f"n % {workers}")
    per = ranged.withColumn("worker", F.explode(F.sequence(F.lit(1), F.lit(workers))))
    skipped = (F.col("worker") - 1) * share + F.least(F.col("worker") - 1, rest)
    size = share + F.when(F.col("worker") <= rest, 1).otherwise(0)
    return per.select(
        "worker", (F.col("lo") + skipped).alias("first_id"), (F.col("lo") + skipped + size - 1).alias("last_id"), size.alias("keys")
    ).filter("keys > 0")


def load_audit(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = (), count: str = "rows") -> DataFrame:
    """Expected against loaded row counts, per key or in total."""
    want = expected.groupBy(*keys).agg(F.sum(count).alias("expected"))
    have = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    if keys:
        both = want.join(have, list(keys), "full")
    else:
        tag = lambda df: df.withColumn("__one", F.lit(1))
        both = tag(want).join(tag(have), "__one", "full").drop("__one")
    want_n, have_n = F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))
    return both.select(
        *keys, want_n.alias("expected"), have_n.alias("actual"), (have_n - want_n).alias("difference"),
        F.when(want_n == have_n, "OK").otherwise("MISMATCH").alias("status"),
    )


def retention_plan(files: DataFrame, date: str, today: Column, compress_after: int, remove_after: int) -> DataFrame:
    """What to do with each day of samples: keep, compress or remove."""
    age = F.date_diff(today, F.col(date).cast("date"))
    return files.withColumn("age_days", age).withColumn(
        "action", F.when(age > remove_after, "REMOVE").when(age > compress_after, "COMPRESS").otherwise("KEEP")
    )


def compact(df: DataFrame, path: str, partition: str, files: int = 8) -> None:
    """Rewrite partitions as a few zstd files each."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    (
        salted.repartition(partition, "__salt").drop("__salt").write.mode("overwrite").option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows only in the old (``-``) or only in the new (``+``) snapshot.

    With ``keys`` a row whose key exists on both sides with other values is one CHANGED row.  Rows
    are told apart by a partial count per distinct row, so copies never meet in one task.
    """
    columns = old.columns
    sides = old.select(*columns, F.lit(1).alias("__o"), F.lit(0).alias("__n")).unionByName(
        new.select(*columns, F.lit(0).alias("__o"), F.lit(1).alias("__n"))
    )
    counted = sides.groupBy(*columns).agg(F.sum("__o").alias("o"), F.sum("__n").alias("n")).filter("o <> n")
    if not keys:
        mark = F.when(F.col("o") > F.col("n"), "-").otherwise("+")
        return counted.select(*columns, mark.alias("change"), F.abs(F.col("o") - F.col("n")).alias("copies"))
    per_key = counted.groupBy(*keys).agg(
        F.max(F.col("o") > F.col("n")).alias("gone"), F.max(F.col("n") > F.col("o")).alias("came")
    )
    kind = F.when(F.col("gone") & F.col("came"), "CHANGED").when(F.col("gone"), "-").otherwise("+")
    return per_key.select(*keys, kind.alias("change"))


def write_batches(df: DataFrame, url: str, table: str, batch: int = 500, properties: dict | None = None) -> None:
    """Append rows to a database table in transactions of ``batch`` rows per task."""
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=properties or {})
