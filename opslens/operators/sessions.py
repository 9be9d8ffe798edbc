"""Session snapshots: counts, totals, deltas and transaction / lock views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.hosts import host_normalize
from opslens.functions.statements import statement_hash
from opslens.functions.text import one_line
from opslens.functions.units import seconds_between
from opslens.operators.filters import exclude_users
from opslens.plans.ordered import SLICE, carried_lag, micros, slice_points, with_slice

AT = ["server", "snapshot_ts"]


def session_counts(
    df: DataFrame,
    by: Sequence[str] = ("user", "db", "host"),
    per: Sequence[str] = (),
    totals: bool = True,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Sessions per key, with one total row per ``per`` group, from a single scan."""
    if exclude:
        df = exclude_users(df, exclude)
    if "host" in by:
        df = df.withColumn("host", host_normalize(F.col("host")))
    if not totals:
        return df.groupBy(*per, *by).agg(F.count(F.lit(1)).alias("connections"))
    detail = [*per, *by]
    counted = df.groupingSets([[F.col(c) for c in detail], [F.col(c) for c in per]], *[F.col(c) for c in detail]).agg(
        F.grouping(by[0]).alias("is_total"), F.count(F.lit(1)).alias("connections")
    )
    return counted.select(*detail, (F.col("is_total") == 1).alias("is_total"), "connections")


def with_previous_snapshot(snapshots: DataFrame, server: str, ts: str) -> DataFrame:
    """Each snapshot time of a server with the one before it (one row per snapshot, not per session)."""
    times = snapshots.select(server, ts).distinct()
    order = micros(F.col(ts))
    sliced = with_slice(times, order, slice_points(times, order))
    return carried_lag(sliced, [server], [ts], {"prev_ts": ts}).drop(SLICE)


def session_delta(
    counts: DataFrame,
    keys: Sequence[str],
    policy: str = "count",
    server: str = "server",
    ts: str = "snapshot_ts",
    value: str = "connections",
) -> DataFrame:
    """Change of every key's count against the server's previous snapshot.

    A key missing from the previous snapshot is new, even when an older snapshot had it:
    ``count`` reports its whole count (0 in the first snapshot), ``new`` labels it, ``zero`` gives 0.
    """
    if policy not in ("count", "new", "zero"):
        raise ValueError("policy must be count, new or zero")
    times = with_previous_snapshot(counts, server, ts)
    current = counts.join(times, [server, ts]).alias("c")
    older = counts.select(
        F.col(server).alias("__server"),
        F.col(ts).alias("__ts"),
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col(value).alias("prev_value"),
    ).alias("p")
    on = (F.col(f"c.{server}") == F.col("p.__server")) & (F.col("c.prev_ts") == F.col("p.__ts"))
    for k in keys:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"p.__{k}"))
    joined = current.join(older, on, "left")
    change = F.col(value) - F.col("prev_value")
    is_first, is_new = F.col("prev_ts").isNull(), F.col("prev_value").isNull()
    if policy == "count":
        delta = F.when(is_first, F.lit(0)).when(is_new, F.col(value)).otherwise(change)
        label = F.format_string("%+d", delta)
    elif policy == "new":
        delta = F.when(is_new, None).otherwise(change)
        label = F.when(is_first, "-").when(is_new, "NEW").otherwise(F.format_string("%+d", change))
    else:
        delta = F.when(is_new, F.lit(0)).otherwise(change)
        label = F.when(delta == 0, "0").otherwise(F.format_string("%+d", delta))
    return joined.select(
        F.col(f"c.{server}").alias(server), F.col(f"c.{ts}").alias(ts), *[F.col(f"c.{k}").alias(k) for k in keys],
        value, "prev_value", delta.cast("long").alias("delta"), label.alias("delta_label"),
    )


def session_delta_totals(
    deltas: DataFrame, server: str = "server", ts: str = "snapshot_ts", value: str = "connections"
) -> DataFrame:
    """Totals per snapshot: all current counts minus the previous counts of the keys still present."""
    return deltas.groupBy(server, ts).agg(
        F.sum(value).alias("connections"),
        (F.sum(value) - F.coalesce(F.sum("prev_value"), F.lit(0))).alias("delta"),
    )


def _dash(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("-"))


def _at(frame: DataFrame, alias: str, names: Sequence[str]) -> DataFrame:
    return frame.select(*AT, *names).alias(alias)


def _on(left: str, left_id: str, right: str, right_id: str) -> Column:
    same = F.col(f"{left}.server") == F.col(f"{right}.server")
    same = same & (F.col(f"{left}.snapshot_ts") == F.col(f"{right}.snapshot_ts"))
    return same & (F.col(f"{left}.{left_id}") == F.col(f"{right}.{right_id}"))


def transaction_view(
    sessions: DataFrame,
    trx: DataFrame,
    threads: DataFrame | None = None,
    events: DataFrame | None = None,
    min_age_s: int = 0,
    own_id: int | None = None,
) -> DataFrame:
    """Active sessions and open transactions with their age at the snapshot.

    Without ``threads`` and ``events`` the age comes from the session and the transaction start.
    """
    view = sessions.alias("p").join(
        _at(trx, "t", ["trx_id", "thread_id", "trx_started"]), _on("p", "id", "t", "thread_id"), "left"
    )
    ages = [
        F.coalesce(F.col("p.time"), F.lit(0)),
        F.coalesce(seconds_between(F.col("t.trx_started"), F.col("p.snapshot_ts")), F.lit(0)),
    ]
    if threads is not None and events is not None:
        view = view.join(
            _at(threads, "th", ["thread_id", "processlist_id"]), _on("p", "id", "th", "processlist_id"), "left"
        ).join(_at(events, "e", ["thread_id", "state", "timer_wait"]), _on("th", "thread_id", "e", "thread_id"), "left")
        timer = F.when(F.col("e.state") == "ACTIVE", F.col("e.timer_wait")).otherwise(0)
        seconds = F.round(timer.cast("decimal(20,0)") / F.lit(10**12).cast("decimal(13,0)")).cast("long")
        ages.append(F.coalesce(seconds, F.lit(0)))
    age = F.greatest(*[a.cast("long") for a in ages])
    shown = F.col("t.trx_id").isNotNull() | (F.col("p.command") != "Sleep")
    if own_id is not None:
        shown = shown & (F.col("p.id") != own_id)
    return view.filter(shown).select(
        F.col("p.server").alias("server"),
        F.col("p.snapshot_ts").alias("snapshot_ts"),
        F.col("p.id").alias("id"),
        _dash(F.col("p.user")).alias("user"),
        _dash(F.col("p.host")).alias("host"),
        _dash(F.col("p.db")).alias("db"),
        age.alias("age_s"),
        _dash(F.col("p.state")).alias("state"),
        F.coalesce("p.info", F.lit("-")).alias("query"),
    ).filter(F.col("age_s") >= min_age_s)


IDLE = "[idle transaction]"


def slow_query_view(
    sessions: DataFrame, threads: DataFrame, trx: DataFrame, statements: DataFrame, min_time: int = 0
) -> DataFrame:
    """Running statements and idle transactions with state, age, start, hash and short text."""
    view = (
        sessions.alias("p")
        .join(
            _at(threads, "th", ["thread_id", "processlist_id", "user", "db", "command", "time", "state"]),
            _on("p", "id", "th", "processlist_id"), "left",
        )
        .join(_at(trx, "t", ["trx_id", "thread_id", "trx_started"]), _on("p", "id", "t", "thread_id"), "left")
        .join(
            _at(statements, "e", ["thread_id", "event_id", "digest", "sql_text"]),
            _on("th", "thread_id", "e", "thread_id"), "left",
        )
    )

    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    command = F.coalesce("th.command", "p.command")
    session_time = F.coalesce(F.col("th.time"), F.col("p.time"), F.lit(0)).cast("long")
    trx_time = F.coalesce(seconds_between(F.col("t.trx_started"), F.col("p.snapshot_ts")), F.lit(0))
    exec_time = F.greatest(session_time, trx_time.cast("long"))
    now = F.unix_micros(F.col("p.snapshot_ts").cast("timestamp"))
    started = F.coalesce(
        F.col("t.trx_started").cast("timestamp"), F.timestamp_micros(now - session_time * 1_000_000)
    )
    text = F.coalesce("e.sql_text", "p.info")
    idle = F.when(command == "Sleep", F.when(F.col("t.trx_id").isNotNull(), F.lit(IDLE)).otherwise("-"))

    def short(name: str) -> Column:
        cut = one_line(F.col(name))
        return F.when(cut != "", cut)

    return view.filter((command != "Sleep") | F.col("t.trx_id").isNotNull()).filter(exec_time >= min_time).select(
        F.col("p.server").alias("server"),
        F.col("p.snapshot_ts").alias("snapshot_ts"),
        F.col("p.id").alias("conn_id"),
        F.coalesce("th.user", "p.user").alias("user"),
        F.coalesce(F.col("th.db"), F.col("p.db"), F.lit("-")).alias("db"),
        F.coalesce(filled("th.state"), filled("p.state"), F.col("th.command"), F.col("p.command"), F.lit("-")).alias("thread_state"),
        F.coalesce(F.col("t.trx_id").cast("string"), F.col("e.event_id").cast("string"), F.lit("-")).alias("trx_q_id"),
        exec_time.alias("exec_time"),
        F.date_format(started, "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.coalesce(
            filled("e.digest"), F.when((command != "Sleep") & text.isNotNull(), statement_hash(text)), F.lit("-")
        ).alias("query_hash"),
        F.coalesce(idle, short("e.sql_text"), short("p.info"), F.lit("-")).alias("query_text"),
    )


def open_trx_view(
    trx: DataFrame, sessions: DataFrame, users: Sequence[str] | None = None,
    db_prefix: str | None = None, min_time: int | None = None,
) -> DataFrame:
    """Open transactions, sleeping ones included, with the session that owns them."""
    view = trx.alias("t").join(sessions.alias("p"), _on("t", "thread_id", "p", "id"), "left")
    if users:
        view = view.filter(F.col("p.user").isin(list(users)))
    if db_prefix:
        view = view.filter(F.col("p.db").startswith(db_prefix))
    if min_time is not None:
        view = view.filter(F.col("p.time") >= min_time)
    text = one_line(F.col("p.info"))
    return view.select(
        F.col("t.server").alias("server"),
        F.col("t.snapshot_ts").alias("snapshot_ts"),
        F.col("t.thread_id").alias("pid"),
        F.coalesce(F.col("p.user"), F.lit("internal/system")).alias("user"),
        F.coalesce(F.col("p.db"), F.lit("-")).alias("db"),
        F.col("t.trx_state").alias("state"),
        F.coalesce(F.col("p.time"), F.lit(0)).alias("trx_time"),
        F.coalesce(F.when(text != "", text), F.lit(IDLE)).alias("query"),
    )


def lock_wait_view(waits: DataFrame, threads: DataFrame, min_age_s: int = 0) -> DataFrame:
    """Who blocks whom, on which table, for how long."""
    names = ["processlist_id", "user", "host"]
    view = (
        waits.filter(F.col("wait_age_secs") >= min_age_s)
        .alias("w")
        .join(_at(threads, "b", names), _on("w", "blocking_pid", "b", "processlist_id"), "left")
        .join(_at(threads, "r", names), _on("w", "waiting_pid", "r", "processlist_id"), "left")
    )

    def account(side: str) -> Column:
        return F.concat(_dash(F.col(f"{side}.user")), F.lit("@"), _dash(F.col(f"{side}.host")))

    return view.select(
        F.col("w.server").alias("server"),
        F.col("w.snapshot_ts").alias("snapshot_ts"),
        "blocking_pid",
        account("b").alias("blocking_account"),
        "waiting_pid",
        account("r").alias("waiting_account"),
        F.concat_ws(".", "locked_schema", "locked_table").alias("locked_object"),
        "wait_age_secs",
        "blocking_query",
        "waiting_query",
    )


def lock_wait_sessions(
    waits: DataFrame, sessions: DataFrame, users: Sequence[str] | None = None,
    db: str | None = None, min_time: int | None = None,
) -> DataFrame:
    """Lock waits with both sessions; a user filter matches either side."""
    names = ["id", "user", "time"]
    view = (
        waits.alias("w")
        .join(_at(sessions, "b", names), _on("w", "blocking_pid", "b", "id"), "left")
        .join(_at(sessions, "r", names), _on("w", "waiting_pid", "r", "id"), "left")
    )
    if users:
        view = view.filter(F.col("b.user").isin(list(users)) | F.col("r.user").isin(list(users)))
    if db:
        view = view.filter(F.col("w.locked_schema") == db)
    if min_time is not None:
        view = view.filter(F.col("r.time") >= min_time)
    blocking, waiting = one_line(F.col("w.blocking_query")), one_line(F.col("w.waiting_query"))
    return view.select(
        F.col("w.server").alias("server"),
        F.col("w.snapshot_ts").alias("snapshot_ts"),
        F.col("w.blocking_pid").alias("blk_id"),
        _dash(F.col("b.user")).alias("blk_user"),
        F.col("w.waiting_pid").alias("wait_id"),
        _dash(F.col("r.user")).alias("wait_user"),
        F.coalesce(F.concat_ws(".", "w.locked_schema", "w.locked_table"), F.lit("-")).alias("locked_obj"),
        F.coalesce(F.col("r.time"), F.lit(0)).alias("wait_time"),
        F.coalesce(F.when(blocking != "", blocking), F.lit(IDLE)).alias("blk_query"),
        F.coalesce(F.when(waiting != "", waiting), F.lit("-")).alias("wait_query"),
    )


def locked_transactions(waits: DataFrame, trx: DataFrame, locks: DataFrame) -> DataFrame:
    """Blocking and waiting transactions of every lock wait, with both locks and suggested statements."""
    trx_names = ["trx_id", "thread_id", "trx_started", "trx_wait_started", "rows_locked", "rows_modified", "query"]
    lock_names = ["lock_id", "lock_mode", "lock_type", "lock_table", "lock_index"]
    view = (
        waits.alias("w")
        .join(_at(trx, "b", trx_names), _on("w", "blocking_trx_id", "b", "trx_id"))
        .join(_at(trx, "r", trx_names), _on("w", "requesting_trx_id", "r", "trx_id"))
        .join(_at(locks, "bl", lock_names), _on("w", "blocking_lock_id", "bl", "lock_id"))
        .join(_at(locks, "rl", lock_names), _on("w", "requested_lock_id", "rl", "lock_id"))
    )
    now = F.col("w.snapshot_ts")
    return view.select(
        F.col("w.server").alias("server"),
        now.alias("snapshot_ts"),
        F.col("r.trx_wait_started").alias("wait_started"),
        seconds_between(F.col("r.trx_wait_started"), now).alias("wait_age_secs"),
        F.col("rl.lock_table").alias("locked_table"),
        F.col("rl.lock_index").alias("locked_index"),
        F.col("rl.lock_type").alias("locked_type"),
        F.col("r.trx_id").alias("waiting_trx_id"),
        seconds_between(F.col("r.trx_started"), now).alias("waiting_trx_age_secs"),
        F.col("r.rows_locked").alias("waiting_trx_rows_locked"),
        F.col("r.rows_modified").alias("waiting_trx_rows_modified"),
        F.col("r.thread_id").alias("waiting_pid"),
        F.col("r.query").alias("waiting_query"),
        F.col("rl.lock_mode").alias("waiting_lock_mode"),
        F.col("b.trx_id").alias("blocking_trx_id"),
        F.col("b.thread_id").alias("blocking_pid"),
        F.col("b.query").alias("blocking_query"),
        F.col("bl.lock_mode").alias("blocking_lock_mode"),
        seconds_between(F.col("b.trx_started"), now).alias("blocking_trx_age_secs"),
        F.col("b.rows_locked").alias("blocking_trx_rows_locked"),
        F.col("b.rows_modified").alias("blocking_trx_rows_modified"),
        F.concat(F.lit("KILL QUERY "), F.col("b.thread_id").cast("string")).alias("sql_kill_blocking_query"),
        F.concat(F.lit("KILL "), F.col("b.thread_id").cast("string")).alias("sql_kill_blocking_connection"),
    )


def open_trx_history(trx, sessions, threads, history, age: int = 10, system_user: str = "SYSTEM_USER") -> DataFrame:
    """Statement history of transactions older than ``age`` seconds."""
    running = seconds_between(F.col("t.trx_started"), F.col("t.snapshot_ts"))
    view = (
        trx.alias("t")
        .join(_at(sessions, "p", ["id", "user"]), _on("t", "thread_id", "p", "id"))
        .join(_at(threads, "th", ["thread_id", "processlist_id"]), _on("t", "thread_id", "th", "processlist_id"))
        .join(_at(history, "h", ["thread_id", "event_id", "event_name", "sql_text"]), _on("th", "thread_id", "h", "thread_id"))
    )
    return view.filter((running > age) & (F.col("p.user") != system_user)).select(
        F.col("t.server").alias("server"),
        F.col("t.snapshot_ts").alias("snapshot_ts"),
        F.col("p.id").alias("process_id"),
        F.col("p.user").alias("username"),
        F.col("h.event_id").alias("event_id"),
        F.col("h.event_name").alias("event_name"),
        running.alias("running_s"),
        F.col("h.sql_text").alias("sql_text"),
    )


def last_statement_of_trx(trx_events: DataFrame, statements: DataFrame, threads: DataFrame) -> DataFrame:
    """Current statement of every transaction that has been active for more than a second."""
    from opslens.functions.units import ps_to_seconds

    on = [*AT, "thread_id"]
    active = trx_events.filter((F.col("state") == "ACTIVE") & (F.col("timer_wait") > 10**12)).select(
        *on, F.col("event_id").alias("trx_event_id"), ps_to_seconds(F.col("timer_wait")).alias("trx_runtime")
    )
    current = statements.select(
        *on, F.col("current_schema").alias("db"), F.col("sql_text").alias("query"), "rows_examined", "rows_affected",
        F.when(F.col("end_event_id").isNull(), "running").otherwise("done").alias("exec_state"),
        ps_to_seconds(F.col("timer_wait")).alias("exec_time"),
    )
    owner = threads.select(
        *on, F.col("processlist_id").alias("process_id"), F.col("user").alias("username"), F.col("host").alias("user_host")
    )
    return active.join(current, on).join(owner, on)


def long_running_trx(trx: DataFrame, sessions: DataFrame, age: int = 1, tz: str | None = None) -> DataFrame:
    """Transactions older than ``age`` seconds with their account; start shown in ``tz`` if given."""
    running = seconds_between(F.col("t.trx_started"), F.col("t.snapshot_ts"))
    started = F.col("t.trx_started")
    if tz:
        started = F.convert_timezone(F.lit("+00:00"), F.lit(tz), started.cast("timestamp_ntz"))
    view = trx.alias("t").join(_at(sessions, "p", ["id", "user", "host"]), _on("t", "thread_id", "p", "id"))
    return view.filter(running > age).select(
        F.col("t.server").alias("server"),
        F.col("t.snapshot_ts").alias("snapshot_ts"),
        "trx_id",
        F.col("t.thread_id").alias("process_id"),
        started.alias("trx_started"),
        running.alias("trx_runtime_s"),
        "trx_state",
        "rows_locked",
        "rows_modified",
        "query",
        F.concat_ws("@", "p.user", "p.host").alias("fullusername"),
    )


def by_age(df: DataFrame, col: str = "age_s", tie: Sequence[str] = ("server", "id")) -> DataFrame:
    return df.orderBy(F.col(col).desc(), *tie)
