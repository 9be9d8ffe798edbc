"""Filters of sessions, statements and documents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.statements import sql_verb
from opslens.functions.text import contains_literal

# Accounts of the servers themselves.
SYSTEM_USERS = ("event_scheduler", "system user", "mysql.session", "mysql.sys")


def parse_list(text: str | Sequence[str] | None, what: str) -> list[str] | None:
    """Items of a comma list; an empty item is an error."""
    if text is None:
        return None
    items = [i.strip() for i in (text.split(",") if isinstance(text, str) else text)]
    if not items or any(not i for i in items):
        raise ValueError(f"{what} list contains an empty item")
    return items


def session_filter(df: DataFrame, users=None, databases=None, hosts=None, cols=("user", "db", "host")) -> DataFrame:
    """Exact values per dimension; every given dimension must match."""
    for values, col, what in zip((users, databases, hosts), cols, ("user", "database", "host")):
        items = parse_list(values, what)
        if items is not None:
            df = df.filter(F.col(col).isin(items))
    return df


def wildcard_filter(col: Column, pattern: str) -> Column:
    """``*`` matches anything; a pattern without wildcard matches anywhere; a missing value is 'none'."""
    like = pattern.replace("*", "%")
    if "%" not in like:
        like = f"%{like}%"
    return F.coalesce(col, F.lit("none")).like(like)


def regex_list_filter(col: Column, value: str) -> Column:
    """Comma-separated regular expressions, case-insensitive, found anywhere; empty matches all."""
    if not value:
        return F.lit(True)
    pattern = value.replace(",", "|")
    re.compile(pattern)
    return F.coalesce(col, F.lit("")).rlike(f"(?i){pattern}")


def glob_filter(col: Column, globs: str) -> Column:
    """Comma-separated ``*``/``?`` globs found anywhere in the lower-cased text."""
    steps = ((".", r"\."), ("*", ".*"), ("?", "."))
    pattern = "|".join(part.strip() for part in globs.lower().split(","))
    for mark, regex in steps:
        pattern = pattern.replace(mark, regex)
    return F.lower(col).rlike(f"({pattern})")


def op_filter(df: DataFrame, ops: Sequence[str], text: str = "query") -> DataFrame:
    """Statements whose leading verb is listed."""
    return df.filter(sql_verb(F.col(text)).isin([o.upper() for o in ops]))


def exclude_users(df: DataFrame, users: Sequence[str] = SYSTEM_USERS, col: str = "user") -> DataFrame:
    """Drop listed accounts; a missing account is dropped as well."""
    return df.filter(~F.col(col).isin(list(users)))


def active_sessions(df: DataFrame, own_id: int | None = None) -> DataFrame:
    """Sessions with an open transaction or a running command."""
    active = F.col("trx_id").isNotNull() | (F.col("command") != "Sleep")
    if own_id is not None:
        active = active & (F.col("id") != own_id)
    return df.filter(active)


def min_age(df: DataFrame, n: int = 0, col: str = "age_s") -> DataFrame:
    return df.filter(F.col(col) >= n)


def doc_active(df: DataFrame) -> DataFrame:
    """Working client operations that do not come from the server itself; no client passes."""
    remote = ~F.coalesce(F.col("client"), F.lit("")).startswith("127.0.0.1")
    return df.filter(F.col("active") & (F.col("desc") != "conn") & (F.col("op") != "none") & remote)


def doc_long_running(df: DataFrame, seconds: int = 10) -> DataFrame:
    return df.filter((F.col("secs_running") > seconds) & F.col("active"))


def object_filter(col: Column, text: str | None) -> Column:
    return contains_literal(col, text) if text else F.lit(True)


def name_like(col: Column, *patterns: str) -> Column:
    """Whether a counter name matches any of the LIKE patterns."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | col.like(pattern)
    return found
