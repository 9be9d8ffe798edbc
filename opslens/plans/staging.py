"""Steps that must be computed once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of repeating.

    The optimizer moves a filter below a projection by writing the projected expression into it,
    which evaluates an expensive parse once more per use.  A generator of one row stays in place.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(packed)).alias("__s")).select(
        *kept, *[F.col(f"__s.{name}").alias(name) for name in columns]
    )


def hashed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add a hash of the keys, to be the first key of a join or window beside them.

    A sort compares rows by the first eight bytes of its first key.  Names of servers and schemas are alike there and
    send every comparison to the whole rows; a hash decides it.  Keys are hashed as text, whatever their types are.
    """
    return df.withColumn(name, F.hash(*[F.col(k).cast("string") for k in keys]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]
