"""Registry of bound queries and the input frames they share.

``FRAMES`` derives snapshots, catalogs and logs from the given tables.  Their texts use the part of
SQL that Spark and the checking engine have in common; operators never see them, only their rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opslens.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FRAMES: dict[str, str] = {}
# Frames whose rows are had for less than by their text: name -> (spark, sf_dir) -> rows.
PLANS: dict[str, Query] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A derived frame as a Spark plan over the tables it names.

    ``dealt`` deals the tables' rows over all cores first: a log's texts are made from short rows, and a table may be
    one split that a single task would make them of and read them in.
    """
    return _frame(spark, sf_dir, name, dealt, {})


def frames(spark: SparkSession, sf_dir: str, *names: str, once: tuple[str, ...] = ()) -> list[DataFrame]:
    """Several frames; those they share that ``once`` names are written once, as plans would compute them for every use."""
    made: dict[str, DataFrame] = {}
    for name in once:
        made[name] = checkpointed(_frame(spark, sf_dir, name, False, made), "frames")
    return [_frame(spark, sf_dir, name, False, made) for name in names]


def _frame(spark: SparkSession, sf_dir: str, name: str, dealt: bool, made: dict[str, DataFrame]) -> DataFrame:
    if name in made:
        return made[name]
    if name in PLANS:
        return PLANS[name](spark, sf_dir)
    text = FRAMES[name]
    used = {n for n in _NAME.findall(text)}

    def source(n: str) -> DataFrame:
        if n not in TABLES:
            return _frame(spark, sf_dir, n, dealt, made)
        rows = table(spark, sf_dir, n)
        return rows.repartition(spark.sparkContext.defaultParallelism) if dealt else rows

    return spark.sql(_escaped(text), **{n: source(n) for n in used})


def _escaped(text: str) -> str:
    """The text with every brace doubled that is not around a name, as the formatter of ``spark.sql`` reads them."""
    parts = _NAME.split(text)  # plain text and names in turn
    return "".join("{%s}" % p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts))


def with_frames(sql: str) -> str:
    """The SQL text with its ``{frame}`` names resolved to common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in FRAMES and name not in order:
                visit(FRAMES[name])
                order.append(name)

    visit(sql)
    plain = lambda text: _NAME.sub(lambda m: m.group(1), text)
    ctes = [f"{name} AS MATERIALIZED ({plain(FRAMES[name])})" for name in order]
    body = plain(sql).strip()
    if not ctes:
        return body
    head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
    joined = ", ".join(ctes)
    return f"{head}{joined}, {rest}" if rest != body else f"{head}{joined} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_frames(sql)
        return fn

    return register
