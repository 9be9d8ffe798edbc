"""Picking values from semi-structured log entries and operation documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text_at(entry: Column, path: str) -> Column:
    """Value at a path, only when it is a JSON string."""
    value = F.try_variant_get(entry, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(entry, path, "string"))


def log_payload(entry: Column) -> Column:
    """Text of a log entry: ``textPayload``, else the first text among the known JSON fields."""
    fields = [_text_at(entry, f"$.jsonPayload.{name}") for name in ("message", "textPayload", "query")]
    return F.coalesce(_text_at(entry, "$.textPayload"), *fields)


def namespace_db(ns: Column) -> Column:
    return F.substring_index(ns, ".", 1)


def command_type(command: Column) -> Column:
    """Name of the first key of a command map."""
    return F.get(F.map_keys(command), F.lit(0))
