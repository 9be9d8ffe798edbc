"""Text helpers: cleaning, matching and rendering, all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_literal(col: Column, text: str) -> Column:
    """Substring test without wildcards; ``%`` and ``_`` are ordinary characters."""
    return F.contains(col, F.lit(text))


def sanitize_text(col: Column) -> Column:
    """One printable line: written-out and real control characters become blanks, blanks collapse."""
    plain = F.regexp_replace(col, r"\\[nrt]", " ")
    plain = F.regexp_replace(plain, r"[\x{0000}-\x{001f}\x{007f}-\x{009f}]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def one_line(col: Column, n: int | None = None) -> Column:
    """Newline and tab to blank, carriage return removed; cut to ``n`` characters if a report asks for that."""
    flat = F.translate(col, "\n\t\r", "  ")
    return flat if n is None else F.substring(flat, 1, n)


def clean_error(col: Column, n: int | None = None, default: str = "unknown error") -> Column:
    """Error text without terminal escapes, on one line, at most ``n`` characters if given."""
    plain = F.regexp_replace(col, r"\x{001b}\[[0-9;?]*[A-Za-z]", "")
    plain = F.translate(plain, "\r\n\x1b", "  ")
    cut = plain if n is None else F.substring(plain, 1, n)
    return F.when(cut.isNull() | (cut == ""), F.lit(default)).otherwise(cut)


def first_n(items: Column, n: int = 3, total: Column | None = None) -> Column:
    """First ``n`` items joined by comma, with the number left out."""
    size = F.size(items) if total is None else total
    head = F.array_join(F.slice(items, 1, n), ", ")
    return F.when(size > n, F.concat(head, F.lit(" (+"), (size - n).cast("string"), F.lit(" more)"))).otherwise(head)


def signed(delta: Column, zero_plain: bool = False) -> Column:
    """``+2`` / ``-2``; a zero carries its sign unless ``zero_plain``."""
    text = F.format_string("%+d", delta)
    if zero_plain:
        text = F.when(delta == 0, F.lit("0")).otherwise(text)
    return F.when(delta.isNotNull(), text)


def display_type(column_type: Column) -> Column:
    """Upper-case type without value lists."""
    return F.upper(F.regexp_replace(column_type, r"(?i)^(enum|set)\(.*\)$", "$1"))


def log_escape(col: Column) -> Column:
    """Escape a text for a quoted SQL literal in a statement file."""
    for raw, escaped in (("\\", "\\\\"), ("'", "''"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        col = F.replace(col, F.lit(raw), F.lit(escaped))
    return col


NUMERIC_TYPE = "int|float|double|decimal|numeric"


def sql_literal(value: Column, data_type: str) -> Column:
    """SQL literal of a text value: NULL for empty or ``\\N``, bare numbers, quoted text."""
    if re.search(NUMERIC_TYPE, data_type.lower()):
        shown = value
    else:
        shown = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.isNull() | (value == "") | (value == "\\N"), F.lit("NULL")).otherwise(shown)


def mentions_table(text: Column, tables: list[str]) -> Column:
    """Whether any of the names occurs in the text."""
    found = F.lit(False)
    for name in tables:
        found = found | contains_literal(text, name)
    return found


def first_mentioned(text: Column, tables: list[str], default: str = "UNKNOWN") -> Column:
    """Upper-cased first name of the list that occurs in the text."""
    lowered = F.lower(text)
    hits = [F.when(F.contains(lowered, F.lit(t.lower())), F.lit(t.upper())) for t in tables]
    return F.coalesce(*hits, F.lit(default))
