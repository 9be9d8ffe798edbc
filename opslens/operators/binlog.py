"""Row-change log accounting.

Counts come from *events* (the text between two ``# at`` marks) and *transactions* (the text up to
a COMMIT).  Both are read as records, so no line order has to be rebuilt across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.timeline import top_k
from opslens.plans.ordered import carried_fill, carried_sum, slice_points, with_slice
from opslens.plans.staging import settled
from opslens.session import checkpointed

ROW_CHANGE = r"(?m)^### (INSERT INTO|UPDATE|DELETE FROM) (\S+)"
HEADER_TIME = r"(?m)^#(\d{6}\s+\d{1,2}:\d{2}:\d{2})"
BLANKS = " \t\n\x0b\f\r"
TABLE_MAP = r"Table_map: (\S+) mapped to number"


def _header_ts(text: Column) -> Column:
    """Time of the first header; NULL without one, and for a day or time that does not exist."""
    found = F.regexp_extract(text, HEADER_TIME, 1)
    day = F.concat_ws("-", F.concat(F.lit("20"), F.substring(found, 1, 2)), F.substring(found, 3, 2), F.substring(found, 5, 2))
    # Written as a cast reads it: a formatter takes twice as long, and every event has a time.
    return F.concat(day, F.lit(" "), F.translate(F.substring(found, 7, 1 << 30), BLANKS, "")).try_cast("timestamp")


def binlog_events(transactions: DataFrame) -> DataFrame:
    """Events of transaction records, in order, for sources that were read per transaction.

    A rows event stays with the table announcement right before it.
    """
    joined = F.regexp_replace("text", r"Table_map: (.*\n)# at .*\n(?=#.*_rows)", "Table_map: $1")
    parts = F.split(joined, r"(?m)^(?=# at )")
    others = [c for c in transactions.columns if c != "text"]
    return transactions.select(*others, F.posexplode(parts).alias("event_id", "text"))


def _change_lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ROW_CHANGE), F.lit(0))


def _changes(lines: Column) -> Column:
    """Rows changed per verb and table of one event, counted inside its record from its lines."""
    kinds = F.array_distinct(lines)

    def kind(line: Column, rows: Column) -> Column:
        verb = F.substring_index(F.substring_index(line, " ", 2), " ", -1)
        return F.struct(verb.alias("op"), F.substring_index(line, " ", -1).alias("table_name"), rows.cast("long").alias("rows_affected"))

    # Nearly all events change rows in one way, which needs no function per element.
    several = F.transform(kinds, lambda k: kind(k, F.size(F.filter(lines, lambda line: line == k))))
    return F.when(F.size(kinds) == 1, F.array(kind(F.get(kinds, F.lit(0)), F.size(lines)))).otherwise(several)


def _by_announcement(changes: Column, announced: Column) -> Column:
    """The same counts under the announced table, one per verb."""
    verbs = F.array_distinct(F.transform(changes, lambda c: c["op"]))
    rows = lambda verb: F.aggregate(F.filter(changes, lambda c: c["op"] == verb), F.lit(0).cast("long"), lambda a, c: a + c["rows_affected"])
    several = F.transform(verbs, lambda verb: F.struct(verb.alias("op"), announced.alias("table_name"), rows(verb).alias("rows_affected")))
    only = F.get(changes, F.lit(0))
    one = F.array(F.struct(only["op"].alias("op"), announced.alias("table_name"), only["rows_affected"].alias("rows_affected")))
    return F.when(F.size(changes) == 1, one).otherwise(several)


def binlog_statements(
    events: DataFrame, keys: tuple[str, ...] = ("file",), attribute: str = "statement", points: Sequence[float] | None = None
) -> DataFrame:
    """Rows changed per event and table.

    ``statement`` attributes rows to the table named by the change itself; an event never leaves its record.
    ``table_map`` attributes them to the last table announced before, in the event or in an earlier one of the same
    ``keys`` by ``event_id``, as a listing by announcements would; a change before any announcement keeps its own table.
    Only announcements and counts go through that ordered pass, no texts.
    """
    if attribute not in ("statement", "table_map"):
        raise ValueError("attribute must be statement or table_map")
    # Most events change no row; they are left out before any pattern runs over them.
    changing = F.contains("text", F.lit("### "))
    if attribute == "statement":
        found = settled(events.filter(changing), __lines=_change_lines(F.col("text")), ts=_header_ts(F.col("text")))
        counted = found.withColumn("__c", _changes(F.col("__lines")))
    else:
        announcing = F.contains("text", F.lit("Table_map: "))
        told = F.when(announcing, F.get(F.reverse(F.regexp_extract_all("text", F.lit(TABLE_MAP), F.lit(1))), F.lit(0)))
        kept = events.filter(changing | announcing)
        # An announcement alone is no statement, so its time is not read.
        read = settled(kept, __lines=F.when(changing, _change_lines(F.col("text"))), ts=F.when(changing, _header_ts(F.col("text"))), __told=told)
        # The ordered pass reads its rows several times; texts are taken apart once.
        narrow = checkpointed(read.withColumn("__c", F.when(F.col("__lines").isNotNull(), _changes(F.col("__lines")))).drop("text", "__lines"), "binlog")
        at = F.col("event_id")
        cut = with_slice(narrow, at, slice_points(narrow, at) if points is None else points)
        filled = carried_fill(cut, list(keys), ["event_id"], "__told", "__announced")
        by_table = F.when(F.col("__announced").isNotNull(), _by_announcement(F.col("__c"), F.col("__announced"))).otherwise(F.col("__c"))
        counted = filled.withColumn("__c", by_table)
    return counted.select(*keys, "event_id", "ts", F.explode("__c").alias("c")).select(
        *keys, "event_id", "ts", "c.table_name", "c.op", "c.rows_affected"
    )


def _verbs(text: Column) -> Column:
    """Verb of every changed row, found in one pass over the text; texts without a change are not searched."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^### (INSERT INTO|UPDATE|DELETE FROM) \S"), F.lit(1))
    return F.when(F.contains(text, F.lit("### ")), found).when(text.isNotNull(), F.array().cast("array<string>"))


def _verb_counts(verbs: str) -> list[Column]:
    n = lambda verb: (F.array_size(verbs) - F.array_size(F.array_remove(verbs, verb))).cast("long")
    return [n("INSERT INTO").alias("inserts"), n("UPDATE").alias("updates"), n("DELETE FROM").alias("deletes")]


def binlog_transactions(transactions: DataFrame) -> DataFrame:
    """Row changes per transaction, counted inside the record without a shuffle."""
    kept = [c for c in transactions.columns if c != "text"]
    read = settled(transactions, ts=_header_ts(F.col("text")), __verbs=_verbs(F.col("text")))
    counted = read.select(*kept, "ts", *_verb_counts("__verbs"))
    return counted.withColumn("total", F.col("inserts") + F.col("updates") + F.col("deletes"))


def binlog_transactions_of_events(events: DataFrame, keys: tuple[str, ...] = ("file",), points: Sequence[float] | None = None) -> DataFrame:
    """Row changes per transaction from event records: no value or task holds a whole transaction.

    A transaction begins after the record that ends the one before it and is known by the ``event_id`` of its first
    event.  Counts are taken inside the records; only they go through the ordered pass, which numbers the transactions
    of a file by the records before that end one.
    """
    text = F.col("text")
    # The position is settled too: a filter on it would find it in the text once more.
    read = settled(
        events, event_id=F.col("event_id"), ts=_header_ts(text),
        __ends=F.contains(text, F.lit("COMMIT")) & text.rlike(r"(?m)^COMMIT"), __verbs=_verbs(text),
    ).filter("event_id is not null")
    # The ordered pass reads its rows several times; texts are taken apart once.
    counted = checkpointed(read.select("*", *_verb_counts("__verbs")).drop("text", "__verbs"), "binlog")
    at = F.col("event_id")
    ended = counted.withColumn("__ended", F.coalesce("__ends", F.lit(True)).cast("long")).drop("__ends")
    cut = with_slice(ended, at, slice_points(ended, at) if points is None else points)
    numbered = carried_sum(cut, list(keys), ["event_id"], "__ended", "__upto").withColumn("__number", F.col("__upto") - F.col("__ended"))
    sums = [F.sum(c).alias(c) for c in ("inserts", "updates", "deletes")]
    timed = F.when(F.col("ts").isNotNull(), at)
    parts = numbered.groupBy(*keys, "__number").agg(
        F.min(at).alias("transaction_id"), F.min_by("ts", timed).alias("ts"), F.min(timed).alias("__timed"), *sums
    )
    # Records that repeat a position may begin two transactions with it, which are known as one.
    whole = parts.groupBy(*keys, "transaction_id").agg(F.min_by("ts", "__timed").alias("ts"), *sums)
    return whole.withColumn("total", F.col("inserts") + F.col("updates") + F.col("deletes"))


def binlog_top_tables(statements: DataFrame, op: str | None = None, k: int | None = None) -> DataFrame:
    """Statements and rows per table and operation, most frequent first."""
    if op:
        statements = statements.filter(F.col("op") == op.upper())
    counted = statements.groupBy("table_name", "op").agg(
        F.count(F.lit(1)).alias("statements"), F.sum("rows_affected").alias("rows_affected")
    )
    order = [F.col("statements").desc(), F.col("rows_affected").desc(), F.col("table_name"), F.col("op")]
    return counted.orderBy(*order) if k is None else counted.orderBy(*order).limit(k)


def binlog_table_ops(statements: DataFrame, table: str) -> DataFrame:
    """How often each operation changed how many rows of one table."""
    one = statements.filter(F.col("table_name") == table)
    return one.groupBy("op", "rows_affected").agg(F.count(F.lit(1)).alias("statements"))


def binlog_top_statements(statements: DataFrame, k: int = 7) -> DataFrame:
    """Statements that changed most rows, per file; other columns only break ties."""
    ties = [c for c in statements.columns if c not in ("file", "rows_affected")]
    return top_k(statements, k, [F.col("rows_affected").desc(), *ties], ["file"])


def binlog_ddl(transactions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Table definitions altered, created and dropped per record, inside a time range if given."""
    kept = [c for c in transactions.columns if c != "text"]
    text = F.col("text")
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^(?:### )?(ALTER|CREATE|DROP) TABLE \S"), F.lit(1)), F.upper)
    # Only texts with the word in any case are searched.
    said = F.contains(F.upper(text), F.lit(" TABLE "))
    verbs = F.when(said, found).when(text.isNotNull(), F.array().cast("array<string>"))
    n = lambda verb: (F.array_size("__verbs") - F.array_size(F.array_remove("__verbs", verb))).cast("long")
    read = settled(transactions, ts=_header_ts(text))
    if start:
        read = read.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        read = read.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return settled(read, __verbs=verbs).select(
        *kept, "ts", n("ALTER").alias("alters"), n("CREATE").alias("creates"), n("DROP").alias("drops"),
    ).withColumn("total", F.col("alters") + F.col("creates") + F.col("drops"))
