"""General query log: payload parsing with a rejection table, and activity counts."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.documents import log_payload
from opslens.plans.staging import once, settled
from opslens.session import checkpointed

# The command names a general log can contain.
COMMANDS = (
    "Sleep", "Quit", "Init DB", "Query", "Field List", "Create DB", "Drop DB", "Refresh", "Shutdown",
    "Statistics", "Processlist", "Connect", "Kill", "Debug", "Ping", "Time", "Delayed insert",
    "Change user", "Binlog Dump", "Table Dump", "Connect Out", "Register Replica", "Register Slave",
    "Prepare", "Execute", "Long Data", "Close stmt", "Reset stmt", "Set option", "Fetch", "Daemon",
    "Binlog Dump GTID", "Reset Connection", "clone", "Group Replication Data Stream subscription", "Error",
)

BLANKS = r"(?U)[\s\x{001c}-\x{001f}]+"
_LONGEST = max(len(c.split()) for c in COMMANDS)
# What a time looks like with every digit a 0: up to six digits of a second may follow.
_TIMES = ["0000-00-00T00:00:00Z", *(f"0000-00-00T00:00:00.{'0' * n}Z" for n in range(1, 7))]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{BLANKS[4:]}|{BLANKS[4:]}\z", "")


def _unindented(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{BLANKS[4:]}", "")


def _read(line: Column) -> Column:
    """The fields of a stripped entry as a struct; a field is NULL where the entry does not have its form.

    An entry is ``time outer[user] @ [host] thread server command argument``.  It is cut at its first two closing
    brackets into time and user, host, and the words that follow.
    """
    return once(F.split(line, "\\]", 3), lambda cut: _fields(F.get(cut, F.lit(0)), F.get(cut, F.lit(1)), F.get(cut, F.lit(2))))


def _name(text: Column) -> Column:
    """What stands in brackets: not empty and in one line."""
    return F.when((text != "") & ~text.contains("\n") & ~text.contains("\r"), strip(text))


def _fields(first: Column, second: Column, rest: Column) -> Column:
    # first: "time outer[user"; a bracket opens directly behind the outer name.
    head, user = F.substring_index(first, "[", 1), first.substr(F.instr(first, F.lit("[")) + 1, F.length(first))
    at = _unindented(second)
    open_host = _unindented(at.substr(F.lit(2), F.length(at)))
    host = F.when(at.startswith("@") & open_host.startswith("["), open_host.substr(F.lit(2), F.length(open_host)))
    words = lambda text, n: F.split(text, BLANKS, n)
    return once(
        F.struct(words(head, -1).alias("head"), words(_unindented(rest), 3).alias("numbers")),
        lambda w: F.struct(
            F.when(first.contains("[") & (F.size(w["head"]) == 2) & (F.get(w["head"], F.lit(1)) != ""), _time(F.get(w["head"], F.lit(0)))).alias("time"),
            _name(user).alias("user"),
            _name(host).alias("host"),
            _digits(F.get(w["numbers"], F.lit(0))).alias("thread"),
            _digits(F.get(w["numbers"], F.lit(1))).alias("server"),
            _command(F.get(w["numbers"], F.lit(2))).alias("command"),
        ),
    )


def _time(word: Column) -> Column:
    shape = F.translate(word, "123456789", "000000000")
    return F.when(shape.isin(_TIMES), F.translate(word, "TZ", " ").try_cast("timestamp_ntz"))


def _digits(word: Column) -> Column:
    return F.when(word.rlike(r"\A\p{Nd}+\z"), word)


def _command(text: Column) -> Column:
    """(name, argument) by the command of most words that the text begins with; NULL without any."""

    def named(words: Column) -> Column:
        name = lambda n: F.array_join(F.slice(words, 1, n), " ")
        # As many words as the longest name has, the rest of the text behind them.
        tries = [F.when((F.size(words) >= n) & name(n).isin([c for c in COMMANDS if len(c.split()) == n]), F.lit(n)) for n in range(_LONGEST, 0, -1)]
        found = [
            F.when(F.coalesce(*tries) == n, F.struct(name(n).alias("name"), F.coalesce(F.get(F.split(text, BLANKS, n + 1), F.lit(n)), F.lit("")).alias("argument")))
            for n in sorted({len(c.split()) for c in COMMANDS})
        ]
        return F.coalesce(*found)

    return once(F.split(text, BLANKS, _LONGEST + 1), named)


def classify_general_log(df: DataFrame, payload: Column) -> DataFrame:
    """Every entry with its parsed fields or the reason for its rejection.

    A time that does not exist is a mismatch like any other.
    """
    read = settled(settled(df, __payload=payload), __line=strip(F.col("__payload")))
    read = settled(read, __e=_read(F.col("__line")))
    e = F.col("__e")
    parts = [e["time"], e["user"], e["host"], e["thread"], e["server"], e["command"]]
    ok = functools.reduce(lambda a, b: a & b, [F.coalesce(p.isNotNull(), F.lit(False)) for p in parts])
    empty = F.coalesce(F.col("__line"), F.lit("")) == ""
    when = lambda value: F.when(ok, value)
    return read.select(
        *df.columns,
        when(e["time"]).alias("event_time"),
        when(F.concat(e["user"], F.lit("@"), e["host"])).alias("user_host"),
        when(e["thread"].try_cast("decimal(20,0)")).alias("thread_id"),
        when(e["server"].try_cast("decimal(20,0)")).alias("server_id"),
        when(e["command"]["name"]).alias("command_type"),
        when(e["command"]["argument"]).alias("argument"),
        F.when(~ok, F.when(empty, "empty payload").otherwise("payload format mismatch")).alias("reason"),
        F.coalesce("__payload", F.lit("")).alias("raw"),
    )


FIELDS = ["event_time", "user_host", "thread_id", "server_id", "command_type", "argument"]


def parse_general_log(df: DataFrame, payload: Column | None = None, chronological: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted entries and rejected ones; ``chronological`` sorts the accepted ones, as of a newest-first export.

    ``df`` holds one log entry per row, as a variant in ``entry`` unless ``payload`` gives its text;
    a NULL ``entry`` in a row of :func:`opslens.sources.logs.cloud_log` is invalid JSON.
    """
    text = log_payload(F.col("entry")) if payload is None else payload
    all_rows = classify_general_log(df, text)
    if "error" in df.columns:
        all_rows = all_rows.withColumn("reason", F.coalesce("error", "reason"))
    extra = [c for c in df.columns if c not in ("entry", "error")]
    accepted = all_rows.filter(F.col("reason").isNull()).select(*extra, *FIELDS)
    if chronological:
        # A sort reads its rows twice, for its bounds and for the sort, and so does every reader of the sorted rows: they are parsed once.
        accepted = checkpointed(accepted, "general-log").orderBy("event_time", "thread_id", "server_id", "command_type", "argument")
    rejected = all_rows.filter(F.col("reason").isNotNull()).select(*extra, "reason", "raw")
    return accepted, rejected


def parse_summary(df: DataFrame, payload: Column) -> DataFrame:
    """Accepted and rejected entries per reason."""
    rows = classify_general_log(df, payload)
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("entries"))


def general_log_from_table(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """A stored copy of the log table under the parser's column names."""
    for old, new in (renames or {}).items():
        df = df.withColumnRenamed(old, new)
    return df.select(
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        "user_host",
        F.col("thread_id").cast("decimal(20,0)").alias("thread_id"),
        F.col("server_id").cast("decimal(20,0)").alias("server_id"),
        "command_type",
        F.col("argument").cast("string").alias("argument"),
    )


def general_log_activity(
    log: DataFrame, by: Sequence[str] = ("user_host", "command_type"), window: str = "1 hour",
    slide: str | None = None, watermark: str | None = None,
) -> DataFrame:
    """Entries per time window and key; ``slide`` makes the windows overlap."""
    log = log.withColumn("event_time", F.col("event_time").cast("timestamp"))
    if watermark:
        log = log.withWatermark("event_time", watermark)
    grouped = log.groupBy(F.window("event_time", window, slide).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("entries")).select(F.col("w.start").alias("window_start"), *by, "entries")
