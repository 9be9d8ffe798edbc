"""Search over the catalog objects of many servers, and privilege summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.text import mentions_table

# Schemas that belong to the server itself.
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "innodb", "tmp", "sys", "percona_toolkit")
# How many distinct privileges amount to all of them, globally and per schema.
ALL_GLOBAL = 20
ALL_SCHEMA = 14


def _terms(text: str | Sequence[str]) -> list[str]:
    items = text.replace(" ", "").split(",") if isinstance(text, str) else list(text)
    if not items or any(not i for i in items):
        raise ValueError("search terms must not be empty")
    return items


def catalog_search(
    objects: DataFrame,
    terms: str | Sequence[str],
    kinds: Sequence[str] | None = None,
    exact: bool = True,
    include: str | None = None,
    exclude: str | None = None,
    related: bool = False,
    system: bool = False,
) -> DataFrame:
    """Objects whose name is listed (or matches one of the expressions) on the chosen servers.

    ``related`` adds the triggers bound to a searched table and the routines that mention one; as
    only an exact name can be bound, it has no effect on a search by expression.
    """
    names = _terms(terms)
    scoped = objects
    for pattern, keep in ((include, True), (exclude, False)):
        if pattern:
            hit = F.col("server").rlike("(?i)" + pattern.replace(" ", "").replace(",", "|"))
            scoped = scoped.filter(hit if keep else ~hit)
    if not system:
        scoped = scoped.filter(~F.coalesce(F.col("schema"), F.lit("")).isin(*SYSTEM_SCHEMAS) | F.col("kind").isin("SCHEMA", "USER"))
    name_hit = F.col("name").isin(names) if exact else F.col("name").rlike("(?i)" + "|".join(names))
    wanted = F.col("kind").isin(list(kinds)) if kinds else F.lit(True)
    match: Column = F.when(name_hit & wanted, F.lit("NAME"))
    if related and exact and (kinds is None or "TABLE" in kinds):
        bound = (F.col("kind") == "TRIGGER") & F.col("attrs")["table"].isin(names)
        acts = F.col("kind").isin("PROCEDURE", "FUNCTION", "ROUTINE") & mentions_table(F.col("attrs")["body"], names)
        match = match.when(bound, "BOUND TRIGGER").when(acts, "ACTS ON")
    return scoped.withColumn("match", match).filter(F.col("match").isNotNull())


def grants_summary(privileges: DataFrame) -> DataFrame:
    """Privileges per server, grantee and level as a list, and the verdict ALL GRANTS where they are all of them.

    ``level`` is GLOBAL, SCHEMA or TABLE; USAGE grants nothing and is left out.  A level has a fixed,
    small set of privilege names, so each list is short.
    """
    keys = ["server", "grantee", "level", "schema", "table"]
    real = privileges.filter(F.col("privilege") != "USAGE")
    per_privilege = real.groupBy(*keys, "privilege").agg(F.max(F.col("grantable") == "YES").alias("grantable"))
    summed = per_privilege.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("grantable").alias("with_option"),
        F.array_join(F.array_sort(F.collect_list("privilege")), ", ").alias("list"),
    )
    limit = F.when(F.col("level") == "GLOBAL", ALL_GLOBAL).when(F.col("level") == "SCHEMA", ALL_SCHEMA)
    everything = F.coalesce(F.col("n") > limit, F.lit(False))
    text = F.when(everything & F.col("with_option"), "ALL GRANTS WITH GRANT OPTION").when(everything, "ALL GRANTS")
    return summed.select(*keys, F.col("n").alias("privileges"), F.col("list").alias("grants"), text.alias("verdict"))
