"""Statement texts: template, hash, verb."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens.plans.staging import once

# The statement verbs the reports know.
VERBS = ("INSERT", "UPDATE", "DELETE", "SELECT", "REPLACE")

# What a value can look like.  A statement is read from left to right, so a quote inside a text of the other kind of
# quotes does not begin a text.
_TEXT = r"(?:_binary *)?(?:'(?:\\.|[^'\\])*+'|\"(?:\\.|[^\"\\])*+\")"
_HEX = r"0x\p{XDigit}+"
_DAY = r"\d{4}(?:-\d\d){2}(?:[T ]\d\d(?::\d\d){2}(?:\.\d+)?)?"
_WORDS = r"\b(?i:null|true|false)\b"
_NUMBER = r"-?\d+(?:\.\d+)?(?:[Ee][+-]?\d+)?"
_MARKS = ",()=<>"
_TOKEN = rf",(?: *,)*|[()=<>]|[^ {_MARKS}]+"
# Neither is left in a statement without control characters.
_TIGHT, _SWAPPED = "\u0001", "\u0002"


def sql_template(statement: Column, literal_keywords: bool = True) -> Column:
    """Statement with every literal replaced by ``?`` and its spacing made uniform.

    Literals inside a token go first.  The rest is read token by token: a token that is a number as a whole becomes
    ``?``, and one blank stands between two tokens, but none before ``)`` and ``,`` and none after ``(``; two commas
    in a row keep one between them.  A blank is kept at either end where the statement has one there, or a mark or number.
    """
    literal = "|".join([_TEXT, _HEX, _DAY, *([_WORDS] if literal_keywords else [])])
    bare = F.regexp_replace(F.regexp_replace(statement, r"\p{Cc}+", ""), literal, "?")
    return once(bare, lambda text: F.when(F.trim(text) == "", F.left(text, F.lit(1))).otherwise(_spaced(text)))


def _spaced(text: Column) -> Column:
    def shown(token: Column) -> Column:
        commas = F.replace(F.replace(token, F.lit(" "), F.lit("")), F.lit(",,"), F.lit(", ,"))
        return (
            F.when(token.startswith(","), F.concat(F.lit(_TIGHT), commas))
            .when(token == ")", _TIGHT + ")")
            .when(token == "(", "(" + _TIGHT)
            .when(token.rlike(rf"\A{_NUMBER}\z"), "?" + _SWAPPED)
            .otherwise(token)
        )

    def ended(tokens: Column) -> Column:
        before = text.startswith(" ") | text.rlike(rf"\A(?:[{_MARKS}]|{_NUMBER}(?:[ {_MARKS}]|\z))")
        after = text.endswith(" ")
        for last in (",", ")", "=", "<", ">", _SWAPPED):
            after = after | tokens.endswith(last)
        blank = lambda wanted: F.when(wanted, " ").otherwise("")
        line = F.concat(blank(before), tokens, blank(after))
        for pair in (" " + _TIGHT, _TIGHT + " "):
            line = F.replace(line, F.lit(pair), F.lit(""))
        return F.translate(line, _TIGHT + _SWAPPED, "")

    return once(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), shown), " "), ended)


def template_hash(template: Column) -> Column:
    return F.substring(F.md5(template.cast("binary")), 1, 12)


def statement_hash(statement: Column) -> Column:
    return F.sha2(statement.cast("binary"), 256)


def sql_verb(statement: Column) -> Column:
    """Leading verb in upper case, NULL for anything else."""
    verb = F.upper(F.regexp_extract(statement, rf"(?i)^({'|'.join(VERBS)})", 1))
    return F.when(verb != "", verb)
