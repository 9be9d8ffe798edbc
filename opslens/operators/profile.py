"""Column cardinality, row drift, key ranking and prefix-index selectivity."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.units import safe_percent, safe_ratio
from opslens.plans.ordered import SLICE, carried_lag
from opslens.plans.staging import hashed, once
from opslens.session import checkpointed

CATALOG_KEYS = ["server", "table_schema", "table_name"]


@dataclass(frozen=True)
class KeyInfo:
    """What the catalog knows about a column's best index."""

    kind: str = "UNAVAILABLE"
    nullable: bool = True
    index: str | None = None
    cardinality: int | None = None


def eligible(col: Column, data_type: T.DataType) -> Column:
    """Whether a value counts for selectivity: present, and not an empty text or a zero date."""
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return col.isNotNull() & (F.octet_length(col) > 0)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.isNotNull() & ~col.cast("string").startswith("0000-00-00")
    return col.isNotNull()


def cardinality_profile(
    df: DataFrame,
    keys: Mapping[str, KeyInfo] | None = None,
    mode: str = "exact",
    estimate: int | None = None,
    columns: Sequence[str] | None = None,
    approx_rsd: float | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Distinct count, eligible count and selectivity of every column of ``df``.

    ``metadata`` reads nothing and gives the catalog's numbers (``estimate`` as row count); it is never
    chosen by size.  Exact mode reads one column per branch, so a columnar source is read once in total and no row
    is multiplied per column; unique columns need no distinct count.  ``approx_rsd`` replaces the
    exact distinct count by a sketch, ``collation`` makes text comparison collation-aware.  A column whose values
    cannot be compared (maps, variants) gives a row of status ERROR without numbers.
    """
    if mode not in ("exact", "metadata"):
        raise ValueError("mode must be exact or metadata")
    keys = keys or {}
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if mode == "metadata":
        return _metadata_profile(df, fields, keys, estimate)

    def branch(ordinal: int, field: T.StructField) -> DataFrame:
        info = keys.get(field.name, KeyInfo())
        col = F.col(f"`{field.name}`")
        if not countable(field.dataType):
            return _failed(df, ordinal, field, info)
        if info.kind == "PRIMARY_SINGLE" or (info.kind == "UNIQUE_SINGLE" and not info.nullable):
            counts, source = [F.count(F.lit(1)), F.count(F.lit(1))], "exact_key_shortcut"
        elif info.kind == "UNIQUE_SINGLE":
            counts, source = [F.count(col), F.count(col)], "exact_unique_nullable"
        else:
            compared = F.collate(col, collation) if collation and isinstance(field.dataType, T.StringType) else col
            kept = F.when(eligible(col, field.dataType), compared)
            distinct = F.count_distinct(kept) if approx_rsd is None else F.approx_count_distinct(kept, approx_rsd)
            counts, source = [F.count(kept), distinct], "exact" if approx_rsd is None else "approximate"
        return df.agg(counts[0].alias("eligible"), counts[1].alias("cardinality")).select(
            F.lit(ordinal).alias("ordinal"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("column_type"),
            "eligible",
            "cardinality",
            F.lit(source).alias("source"),
            F.lit(info.index).cast("string").alias("source_index"),
            F.lit("OK").alias("status"),
        )

    branches = [branch(i, f) for i, f in enumerate(fields, start=1)]
    return _with_metrics(reduce(DataFrame.unionByName, branches))


def countable(kind: T.DataType) -> bool:
    """Whether values of a type can be told apart: not maps or variants, nor what holds them."""
    if isinstance(kind, T.ArrayType):
        return countable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(countable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _failed(df: DataFrame, ordinal: int, field: T.StructField, info: KeyInfo) -> DataFrame:
    none = F.lit(None).cast("long")
    return df.sparkSession.range(1).select(
        F.lit(ordinal).alias("ordinal"), F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("column_type"),
        none.alias("eligible"), none.alias("cardinality"), F.lit("UNAVAILABLE").alias("source"),
        F.lit(info.index).cast("string").alias("source_index"), F.lit("ERROR").alias("status"),
    )


def profile_sketches(df: DataFrame, by: Sequence[Column] = (), columns: Sequence[str] | None = None, lg_k: int = 12) -> DataFrame:
    """(by..., ordinal, column_name, column_type, eligible, sketch): counts that can be stored and added up later.

    All columns are counted in one pass over the rows, a group of ``by`` (the file or day, say) at a time, so a growing
    table needs only its new parts read.  A column that cannot be compared has no sketch.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    parts = []
    for i, field in enumerate(fields, start=1):
        col = F.col(f"`{field.name}`")
        kept = F.when(eligible(col, field.dataType), col)
        if not countable(field.dataType):
            parts += [F.lit(None).cast("long").alias(f"n{i}"), F.lit(None).cast("binary").alias(f"s{i}")]
            continue
        # Whole numbers, texts and bytes are sketched as they are, anything else as its text.
        simple = isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
        parts += [F.count(kept).alias(f"n{i}"), F.hll_sketch_agg(kept if simple else F.to_json(F.struct(kept)) if _nested(field.dataType) else kept.cast("string"), F.lit(lg_k)).alias(f"s{i}")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *parts)
    rows = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), F.col(f"n{i}").alias("eligible"), F.col(f"s{i}").alias("sketch"))
        for i, f in enumerate(fields, start=1)
    ]
    others = [c for c in wide.columns if c not in {f"{t}{i}" for t in "ns" for i in range(1, len(fields) + 1)}]
    return wide.select(*others, F.explode(F.array(*rows)).alias("c")).select(*[c for c in others if c != "rows"], "c.*")


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.StructType))


def profile_from_sketches(stored: DataFrame) -> DataFrame:
    """The profile of all stored parts together; distinct counts are estimates of the united sketches."""
    united = stored.groupBy("ordinal", "column_name", "column_type").agg(
        F.sum("eligible").alias("eligible"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cardinality")
    )
    known = F.col("cardinality").isNotNull() & F.col("eligible").isNotNull()
    counted = united.select(
        "ordinal", "column_name", "column_type", "eligible", F.when(known, F.least("cardinality", "eligible")).alias("cardinality"),
        F.when(known, "sketch").otherwise("UNAVAILABLE").alias("source"), F.lit(None).cast("string").alias("source_index"),
        F.when(known, "OK").otherwise("ERROR").alias("status"),
    )
    return _with_metrics(counted)


def _metadata_profile(df, fields, keys, estimate) -> DataFrame:
    rows = []
    for i, field in enumerate(fields, start=1):
        info = keys.get(field.name, KeyInfo())
        known = info.kind != "UNAVAILABLE"
        rows.append(
            (
                i, field.name, field.dataType.simpleString(), estimate,
                info.cardinality if known else None,
                "metadata" if known else "UNAVAILABLE",
                info.index if known else None,
                "OK" if known else "WARNING",
            )
        )
    schema = (
        "ordinal int, column_name string, column_type string, eligible long, cardinality long, "
        "source string, source_index string, status string"
    )
    return _with_metrics(df.sparkSession.createDataFrame(rows, schema))


def _with_metrics(counts: DataFrame) -> DataFrame:
    ratio = safe_ratio(F.col("cardinality"), F.col("eligible"), 4)
    pct = safe_percent(F.col("cardinality"), F.col("eligible"), 2)
    return counts.withColumn("ratio", ratio).withColumn("selectivity_pct", pct)


def order_profile(profile: DataFrame, by: str = "cardinality") -> DataFrame:
    """Numbers first and largest first, then unknown values, then failed columns."""
    first, second = ("cardinality", "selectivity_pct") if by == "cardinality" else ("selectivity_pct", "cardinality")

    def rank(metric: str) -> Column:
        return F.when(F.col("status") == "ERROR", 2).when(F.col(metric).isNull(), 1).otherwise(0)

    return profile.orderBy(
        rank(first), F.col(first).desc_nulls_last(), rank(second), F.col(second).desc_nulls_last(), "ordinal"
    )


def row_drift(exact: Column, estimate: Column, zero_policy: str = "zero") -> Column:
    """Distance of the estimate from the exact count in percent of the exact count.

    An empty table gives 0 under ``zero``; under ``hundred`` it gives 100 unless the estimate is 0.
    """
    if zero_policy not in ("zero", "hundred"):
        raise ValueError("zero_policy must be 'zero' or 'hundred'")
    empty = F.lit(0.0) if zero_policy == "zero" else F.when(estimate == 0, 0.0).otherwise(100.0)
    drift = safe_percent(F.abs(exact - estimate), exact, 2)
    return F.when(estimate.isNull(), None).when(exact == 0, empty).otherwise(drift)


def drift_flag(drift: Column, limit: float = 10.0) -> Column:
    """WARNING for a drift of more than ``limit`` percent, OK up to it, NULL for none known."""
    return F.when(drift > limit, "WARNING").when(drift.isNotNull(), "OK")


def column_key_info(columns: DataFrame, statistics: DataFrame) -> DataFrame:
    """Best index, key kind and index list of every column.

    Statistics are read once: index widths come from a window over one index (at most 16 columns),
    the rest from one over the few indexes that contain a column.  Both windows lie within a table,
    by which the statistics are dealt once; only the best index of a column is dealt again, to meet it.
    """
    of_index = Window.partitionBy("__table", *CATALOG_KEYS, "index_name")
    leading, single, unique = (
        F.col("seq_in_index") == 1, F.col("index_columns") == 1, F.col("non_unique") == 0,
    )
    rank = F.when(leading & single & unique, 1).when(leading & single, 2).when(leading, 3).otherwise(4)
    not_primary = F.when(F.col("index_name") == "PRIMARY", 0).otherwise(1)
    kind = (
        F.when(~leading, "UNAVAILABLE")
        .when(single & (F.col("index_name") == "PRIMARY"), "PRIMARY_SINGLE")
        .when(single & unique, "UNIQUE_SINGLE")
        .when(single, "LEADING_SINGLE")
        .otherwise("LEADING_COMPOSITE")
    )
    found = F.struct(
        F.when(leading, F.col("cardinality")).alias("metadata_cardinality"),
        F.when(leading, F.col("index_name")).alias("source_index"),
        kind.alias("key_kind"),
        F.col("index_columns"),
    )
    label = F.concat("index_name", F.lit("(#"), F.col("seq_in_index").cast("string"), F.lit(")"))
    column_keys = ["__table", *CATALOG_KEYS, "column_name"]
    of_column = Window.partitionBy(*column_keys).orderBy(rank, not_primary, "index_name")
    all_before, all_after = Window.unboundedPreceding, Window.unboundedFollowing
    best = (
        hashed(statistics, CATALOG_KEYS, "__table").repartition("__table").withColumn("index_columns", F.count(F.lit(1)).over(of_index))
        .select(
            *column_keys,
            found.alias("b"),
            F.row_number().over(of_column).alias("rn"),
            F.collect_list(F.struct("index_name", "seq_in_index", label.alias("label"))).over(of_column.rowsBetween(all_before, all_after)).alias("l"),
        )
        .filter("rn = 1")
        .select(*column_keys, "b.*", F.array_join(F.transform(F.array_sort("l"), lambda x: x["label"]), ", ").alias("indexes"))
    )
    return (
        hashed(columns, CATALOG_KEYS, "__table").join(best, column_keys, "left")
        .drop("__table")
        .withColumn("key_kind", F.coalesce("key_kind", F.lit("UNAVAILABLE")))
        .withColumn("index_columns", F.coalesce("index_columns", F.lit(0)))
        .withColumn("indexes", F.coalesce("indexes", F.lit("---")))
    )


def index_coverage(relations: DataFrame, statistics: DataFrame) -> DataFrame:
    """Estimated distinct tuples of each relation, read at the tuple's last column in its index."""
    at_end = statistics.select(
        "server",
        F.col("table_schema").alias("source_schema"),
        F.col("table_name").alias("source_table"),
        F.col("index_name").alias("supporting_index"),
        F.col("seq_in_index").alias("components"),
        F.col("cardinality").alias("estimated_tuples"),
    )
    sized = relations.withColumn("components", F.size("source_columns"))
    on = ["server", "source_schema", "source_table", "supporting_index", "components"]
    return sized.join(at_end, on, "left")


def index_examiner(statistics: DataFrame) -> DataFrame:
    """Every indexed column with its index, uniqueness, position and the index's ordered columns."""
    keys = [*CATALOG_KEYS, "index_name"]
    ordered = statistics.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq_in_index", "column_name"))), lambda x: x["column_name"]),
            ", ",
        ).alias("index_column_list")
    )
    return statistics.join(ordered, keys).select(
        *keys,
        "column_name",
        F.when(F.col("non_unique") == 0, "UNIQUE").otherwise("NON_UNIQUE").alias("uniqueness"),
        "seq_in_index",
        "index_column_list",
    )


TARGET_RATIO = 0.95
MARGINAL_GAIN = 0.01


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def common_length(left: Column, right: Column, most: int) -> Column:
    """How many characters two different texts begin with in common, ``most`` at the most; 0 where one is NULL."""
    found = F.lit(0)
    step = 1 << max(0, most.bit_length() - 1)
    while step:
        # Longer common beginnings contain the shorter ones, so the length is found bit by bit.
        found = once(found, _longer_by(step, left, right))
        step //= 2
    return found


def _longer_by(step: int, left: Column, right: Column) -> Callable[[Column], Column]:
    return lambda p: p + F.when(F.left(left, p + step) == F.left(right, p + step), step).otherwise(0)


def prefix_selectivity(
    df: DataFrame, columns: Sequence[str] | None = None, max_prefix: int = 50, pad_space: bool = False
) -> DataFrame:
    """Selectivity of every prefix length of text columns.

    The distinct values are sorted by ranges.  A value begins a new prefix of every length beyond the characters it has
    in common with its predecessor, so a histogram of those common lengths, summed up from the left, gives the distinct
    prefixes of all lengths; no value is repeated per length.  Two length bounds per column come to the driver.  A
    column without a value gives one row with no prefix length.
    """
    names = list(columns or string_columns(df))

    def kept(name: str) -> Column:
        col = F.col(f"`{name}`")
        filled = (F.rtrim(col) if pad_space else col) != ""
        return F.when(col.isNotNull() & filled, col)

    bounds = df.agg(
        *[f(F.char_length(kept(n))).alias(f"{tag}{i}") for i, n in enumerate(names) for tag, f in (("lo", F.min), ("hi", F.max))]
    ).first()

    def one(i: int, name: str) -> DataFrame:
        if bounds[f"hi{i}"] is None:
            return df.sparkSession.range(1).select(
                F.lit(name).alias("column_name"), *[F.lit(None).cast(t).alias(c) for c, t in (("prefix_length", "int"), ("distinct_prefixes", "long"))],
                F.lit(0).cast("long").alias("rows"), F.lit(None).cast("double").alias("selectivity"),
            )
        low = max(1, bounds[f"lo{i}"])
        high = max(low, min(bounds[f"hi{i}"], max_prefix))
        values = df.select(F.left(kept(name), F.lit(high)).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        # Written, so that the ranges a value and its predecessor are found in stay as they are.
        ranged = checkpointed(values.repartitionByRange("v").withColumn(SLICE, F.spark_partition_id()), "prefixes")
        lagged = carried_lag(ranged, [], ["v"], {"before": "v"})
        per_length = lagged.select(common_length(F.col("before"), F.col("v"), high).alias("common"), "n").groupBy("common").agg(
            F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")
        )
        # One row of at most high + 1 counts.
        all_lengths = per_length.agg(F.collect_list(F.struct("common", "values")).alias("h"), F.sum("n").alias("rows"))
        return all_lengths.select("h", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("prefix_length")).select(
            F.lit(name).alias("column_name"),
            "prefix_length",
            F.expr("aggregate(filter(h, x -> x.common < prefix_length), 0L, (a, x) -> a + x.values)").alias("distinct_prefixes"),
            "rows",
        ).withColumn("selectivity", safe_ratio(F.col("distinct_prefixes"), F.col("rows"), 4))

    found = [one(i, n) for i, n in enumerate(names)]
    if not found:
        return df.sparkSession.createDataFrame(
            [], "column_name string, prefix_length int, distinct_prefixes long, rows long, selectivity double"
        )
    return reduce(DataFrame.unionByName, found)


def recommend_prefix(selectivity: DataFrame) -> DataFrame:
    """Shortest prefix near the best selectivity whose last step gained little, else the full column.

    Its input has at most ``max_prefix`` rows per column.
    """
    per_column = Window.partitionBy("column_name").orderBy("prefix_length")
    previous = F.coalesce(F.lag("selectivity").over(per_column), F.lit(0.0))
    best = F.last("selectivity").over(per_column.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    four = "decimal(10,4)"
    gain = F.col("selectivity").cast(four) - F.col("previous").cast(four)
    enough = F.col("selectivity").cast(four) >= F.col("best").cast(four) * F.lit(TARGET_RATIO).cast("decimal(3,2)")
    fits = enough & (gain <= F.lit(MARGINAL_GAIN).cast("decimal(3,2)"))
    scored = selectivity.withColumn("previous", previous).withColumn("best", best)
    picked = F.min(F.when(fits, F.col("prefix_length")))
    return scored.groupBy("column_name").agg(picked.alias("prefix_length"), F.max("best").alias("full_selectivity")).withColumn(
        "recommendation",
        F.when(F.col("full_selectivity").isNull(), "no values").when(F.col("prefix_length").isNull(), "full column").otherwise(
            F.concat("column_name", F.lit("("), F.col("prefix_length").cast("string"), F.lit(")"))
        ),
    )
