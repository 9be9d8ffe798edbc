"""Order-dependent computation that does not put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts every row of a key in one task, which fails
as soon as one key holds a large share of the data.  Here each key is cut along the order column
into *slices*; every slice is windowed on its own, and only one summary row per (key, slice) is
carried over to the following slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"
_CARRY = "__carry"
_ONE_SLICE = "one_slice"
ROWS_PER_SLICE = 2_000_000
MAX_SLICES = 4096


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def slice_points(
    df: DataFrame,
    order: Column,
    rows_per_slice: int = ROWS_PER_SLICE,
    max_slices: int = MAX_SLICES,
) -> list[float]:
    """Cut points of a numeric order expression so that slices hold about ``rows_per_slice`` rows.

    One aggregation counts the rows and draws a bounded quantile sketch at ``max_slices`` even
    places, that many numbers for the driver; the count decides which of them are points.  The rows
    are computed once for it, however costly they are.  The points only balance the work, any
    values give the same result.
    """
    fractions = [i / max_slices for i in range(1, max_slices)] or [0.5]
    sketch = F.percentile_approx("v", fractions, max(10_000, 4 * max_slices))
    found = df.select(order.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"), sketch.alias("q")).first()
    wanted = min(max_slices, -(-found["n"] // rows_per_slice))
    if wanted <= 1 or not found["q"]:
        return []
    return sorted({found["q"][round(i * max_slices / wanted) - 1] for i in range(1, wanted)})


def with_slice(df: DataFrame, order: Column, points: Sequence[float]) -> DataFrame:
    """Add the slice number of each row (binary search over the cut points, in the JVM)."""
    if not points:
        return df.withColumn(SLICE, F.lit(0).alias(SLICE, metadata={_ONE_SLICE: True}))
    splits = [float("-inf"), *points, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="__order", outputCol=SLICE, handleInvalid="keep")
    keyed = df.withColumn("__order", order.cast("double"))
    return cutter.transform(keyed).drop("__order").withColumn(SLICE, F.col(SLICE).cast("int"))


def _by(keys: Sequence[str]):
    # A constant key keeps the carry of a global order, one row per slice, in one small group.
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _with_carry(rows: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Rows plus the one row per (key, slice) that brings in what earlier slices know."""
    marked = rows.withColumn(_CARRY, F.lit(0))
    if carry is None:
        return marked
    return marked.unionByName(carry.withColumn(_CARRY, F.lit(1)), allowMissingColumns=True)


def _in_slice(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(F.desc(_CARRY), *order)


def _single(sliced: DataFrame) -> bool:
    return bool(sliced.schema[SLICE].metadata.get(_ONE_SLICE))


def carried_lag(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str]
) -> DataFrame:
    """Previous row's values per key, ``{output: input}``; the first row of a key gets NULL.

    The last row of a slice is handed to the key's next slice as one extra row, so the rows are
    shuffled once and never joined.
    """
    payload = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    carry = None
    if not _single(sliced):
        position = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        tails = sliced.groupBy(*keys, SLICE).agg(F.max_by(payload, position).alias("__p"))
        following = F.lead(SLICE).over(_by(keys).orderBy(SLICE))
        carry = tails.select(*keys, following.alias(SLICE), "__p").filter(F.col(SLICE).isNotNull())
    both = _with_carry(sliced.withColumn("__p", payload), carry)
    previous = F.lag("__p").over(_in_slice(keys, order))
    return both.withColumn("__prev", previous).filter(F.col(_CARRY) == 0).select(
        *sliced.columns, *[F.col(f"__prev.{out}").alias(out) for out in values]
    )


def _running(sliced, keys, order, value, out, fold) -> DataFrame:
    """Running fold (sum or max) per key; earlier slices enter as one row with their fold."""
    until = Window.unboundedPreceding
    carry = None
    if not _single(sliced):
        parts = sliced.groupBy(*keys, SLICE).agg(fold(value).alias("__v"))
        earlier = fold("__v").over(_by(keys).orderBy(SLICE).rowsBetween(until, -1))
        carry = parts.select(*keys, SLICE, earlier.alias("__v")).filter(F.col("__v").isNotNull())
    both = _with_carry(sliced.withColumn("__v", F.col(value)), carry)
    so_far = fold("__v").over(_in_slice(keys, order).rowsBetween(until, 0))
    return both.withColumn(out, so_far).filter(F.col(_CARRY) == 0).select(*sliced.columns, out)


def carried_sum(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Running sum per key up to and including the row."""
    return _running(sliced, keys, order, value, out, F.sum)


def carried_last(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Latest non-null ``value`` per key so far; ``value`` must not decrease along the order."""
    return _running(sliced, keys, order, value, out, F.max)


def carried_fill(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Latest non-null ``value`` per key up to and including the row, whatever the values.

    Every (key, slice) hands its last value on; the carry row of a slice brings in the last one before it.
    """
    until = Window.unboundedPreceding
    carry = None
    if not _single(sliced):
        known = F.col(value).isNotNull()
        position = F.when(known, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]))
        parts = sliced.groupBy(*keys, SLICE).agg(F.max_by(value, position).alias("__v"))
        earlier = F.last("__v", ignorenulls=True).over(_by(keys).orderBy(SLICE).rowsBetween(until, -1))
        carry = parts.select(*keys, SLICE, earlier.alias("__v")).filter(F.col("__v").isNotNull())
    both = _with_carry(sliced.withColumn("__v", F.col(value)), carry)
    latest = F.last("__v", ignorenulls=True).over(_in_slice(keys, order).rowsBetween(until, 0))
    return both.withColumn(out, latest).filter(F.col(_CARRY) == 0).select(*sliced.columns, out)


def carried_lags(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, shifts: dict[str, int]
) -> DataFrame:
    """``value`` of the rows that many places before, per key: ``{output: places}``.

    A slice is handed the last rows before it, as many as the widest shift, as carry rows.  They lie in as many
    slices before it at most, as every slice of a key has a row.
    """
    n = max(shifts.values())
    carry = None
    if not _single(sliced):
        position = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        from_end = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*[F.desc(c) for c in order]))
        last = sliced.select(*keys, SLICE, F.struct(position.alias("o"), F.col(value).alias("v")).alias("__t"), from_end.alias("__r"))
        tails = last.filter(F.col("__r") <= n).groupBy(*keys, SLICE).agg(F.array_sort(F.collect_list("__t")).alias("__t"))
        before = F.flatten(F.collect_list("__t").over(_by(keys).orderBy(SLICE).rowsBetween(-n, -1)))
        newest = F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n)
        handed = tails.select(*keys, SLICE, newest.alias("__n")).select(*keys, SLICE, F.explode("__n").alias("__n"))
        carry = handed.select(*keys, SLICE, *[F.col(f"__n.o.o{i}").alias(c) for i, c in enumerate(order)], F.col("__n.v").alias("__v"))
    both = _with_carry(sliced.withColumn("__v", F.col(value)), carry)
    window = _in_slice(keys, order)
    for out, places in shifts.items():
        both = both.withColumn(out, F.lag("__v", places).over(window))
    return both.filter(F.col(_CARRY) == 0).select(*sliced.columns, *shifts)
