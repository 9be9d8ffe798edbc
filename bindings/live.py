"""Session, transaction, lock, proxy, pool and document snapshots."""

from pyspark.sql import functions as F

from bindings.registry import FRAMES, frame, query, table
from opslens.functions import bands, documents as docs, hosts, units
from opslens.operators import documents, filters, pool, proxy, sessions

_HOST = """CASE WHEN host LIKE '[%' THEN split_part(substr(host, 2), ']', 1)
    WHEN length(host) - length(replace(host, ':', '')) > 1 THEN regexp_replace(host, ':[^:]*$', '')
    ELSE array_to_string(string_split(split_part(host, ':', 1), '.')[1:4], '.') END"""


@query("host_normalize", f"SELECT id, host, {_HOST} AS host_norm FROM {{sessions}}")
def host_normalize(spark, sf_dir):
    return frame(spark, sf_dir, "sessions").select("id", "host", hosts.host_normalize(F.col("host")).alias("host_norm"))


@query(
    "session_counts",
    f"""
    WITH s AS (SELECT server, snapshot_ts, "user", db, {_HOST} AS host FROM {{sessions}} WHERE "user" NOT IN ('mysql.sys', 'event_scheduler', 'system user', 'mysql.session'))
    SELECT server, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, "user", db, host, false AS is_total, count(*) AS connections FROM s GROUP BY server, snapshot_ts, "user", db, host
    UNION ALL SELECT server, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S'), NULL, NULL, NULL, true, count(*) FROM s GROUP BY server, snapshot_ts
    """,
)
def session_counts(spark, sf_dir):
    rows = frame(spark, sf_dir, "sessions")
    counted = sessions.session_counts(rows, per=["server", "snapshot_ts"], exclude=filters.SYSTEM_USERS)
    return _text_ts(counted, "snapshot_ts")


def _text_ts(df, *names):
    for name in names:
        df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return df


_COUNTS = """c AS (SELECT server, snapshot_ts, "user", db, count(*) AS connections FROM {event_sessions} GROUP BY ALL),
    t AS (SELECT server, snapshot_ts, lag(snapshot_ts) OVER (PARTITION BY server ORDER BY snapshot_ts) AS prev_ts FROM (SELECT DISTINCT server, snapshot_ts FROM c)),
    j AS (SELECT c.*, t.prev_ts, p.connections AS prev_value FROM c JOIN t USING (server, snapshot_ts)
          LEFT JOIN c p ON p.server = c.server AND p.snapshot_ts = t.prev_ts AND p."user" IS NOT DISTINCT FROM c."user" AND p.db IS NOT DISTINCT FROM c.db)"""
_SIGNED = "CASE WHEN {d} >= 0 THEN '+' || CAST({d} AS VARCHAR) ELSE CAST({d} AS VARCHAR) END"
_DELTA = {
    "count": (
        "CASE WHEN prev_ts IS NULL THEN 0 WHEN prev_value IS NULL THEN connections ELSE connections - prev_value END",
        _SIGNED.format(d="delta"),
    ),
    "new": (
        "connections - prev_value",
        "CASE WHEN prev_ts IS NULL THEN '-' WHEN prev_value IS NULL THEN 'NEW' ELSE " + _SIGNED.format(d="delta") + " END",
    ),
    "zero": (
        "coalesce(connections - prev_value, 0)",
        "CASE WHEN delta = 0 THEN '0' ELSE " + _SIGNED.format(d="delta") + " END",
    ),
}


def _counts(spark, sf_dir):
    rows = frame(spark, sf_dir, "event_sessions")
    return rows.groupBy("server", "snapshot_ts", "user", "db").agg(F.count(F.lit(1)).alias("connections"))


def _bind_delta(policy: str) -> None:
    delta, label = _DELTA[policy]

    @query(
        f"session_delta_{policy}",
        f"""WITH {_COUNTS}, d AS (SELECT *, {delta} AS delta FROM j)
        SELECT server, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, "user", db, connections, prev_value, delta, {label} AS delta_label FROM d""",
    )
    def run(spark, sf_dir):
        return _text_ts(sessions.session_delta(_counts(spark, sf_dir), ["user", "db"], policy), "snapshot_ts")


for _policy in _DELTA:
    _bind_delta(_policy)


@query(
    "session_delta_totals",
    f"""WITH {_COUNTS} SELECT server, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, CAST(sum(connections) AS BIGINT) AS connections,
        CAST(sum(connections) - coalesce(sum(prev_value), 0) AS BIGINT) AS delta FROM j GROUP BY server, snapshot_ts""",
)
def session_delta_totals(spark, sf_dir):
    deltas = sessions.session_delta(_counts(spark, sf_dir), ["user", "db"], "new")
    return _text_ts(sessions.session_delta_totals(deltas), "snapshot_ts")


@query(
    "session_filter",
    """SELECT id, "user", db, host FROM {sessions} WHERE "user" IN ('app3', 'app5') AND db IN ('shop_1') AND (host = 'node1.rack.zone.dc.example.com' OR host = 'node3.rack.zone.dc.example.com')""",
)
def session_filter(spark, sf_dir):
    rows = filters.session_filter(
        frame(spark, sf_dir, "sessions"), "app3,app5", "shop_1", ["node1.rack.zone.dc.example.com", "node3.rack.zone.dc.example.com"]
    )
    return rows.select("id", "user", "db", "host")


@query(
    "session_text_filters",
    """
    SELECT id, contains(coalesce(db, ''), 'p_') AS literal_db, coalesce(db, 'none') LIKE 'shop%' AS wild_db, coalesce(db, 'none') LIKE '%none%' AS none_db,
        regexp_matches(coalesce("user", ''), '(?i)APP1|sys') AS regex_user, coalesce(regexp_matches(lower(info), '(ord.*9|cust = 1.)'), false) AS glob_query
    FROM {sessions}
    """,
)
def session_text_filters(spark, sf_dir):
    return frame(spark, sf_dir, "sessions").select(
        "id",
        filters.object_filter(F.coalesce("db", F.lit("")), "p_").alias("literal_db"),
        filters.wildcard_filter(F.col("db"), "shop*").alias("wild_db"),
        filters.wildcard_filter(F.col("db"), "none").alias("none_db"),
        filters.regex_list_filter(F.col("user"), "APP1,sys").alias("regex_user"),
        F.coalesce(filters.glob_filter(F.col("info"), "ord*9 , cust = 1?"), F.lit(False)).alias("glob_query"),
    )


@query("exclude_users", """SELECT id, "user" FROM {sessions} WHERE "user" NOT IN ('mysql.sys', 'app2')""")
def exclude_users(spark, sf_dir):
    return filters.exclude_users(frame(spark, sf_dir, "sessions"), ["mysql.sys", "app2"]).select("id", "user")


@query(
    "statements_by_verb",
    """SELECT id, upper(regexp_extract(q, '^(?i)(insert|update|delete|select|replace)', 1)) AS op FROM
       (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'insert into a' WHEN 1 THEN 'Update a' WHEN 2 THEN 'with insert' ELSE 'SELECT 1' END AS q FROM orders)
       WHERE upper(regexp_extract(q, '^(?i)(insert|update|delete|select|replace)', 1)) IN ('INSERT', 'UPDATE')""",
)
def statements_by_verb(spark, sf_dir):
    from opslens.functions.statements import sql_verb

    texts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("element_at(array('insert into a', 'Update a', 'with insert', 'SELECT 1'), cast(o_orderkey % 4 as int) + 1)").alias("query"),
    )
    return filters.op_filter(texts, ["insert", "update"]).select("id", sql_verb(F.col("query")).alias("op"))


_AGE3 = """greatest(coalesce(p.time, 0), coalesce(date_diff('second', t.trx_started, p.snapshot_ts), 0),
    coalesce(CAST(round((CASE WHEN e.state = 'ACTIVE' THEN e.timer_wait ELSE 0 END) / 1000000000000.0::DOUBLE) AS BIGINT), 0))"""
_ON = "{a}.server = {b}.server AND {a}.snapshot_ts = {b}.snapshot_ts AND "


def _on(a, b):
    return _ON.format(a=a, b=b)


@query(
    "transaction_view",
    f"""
    SELECT p.server, strftime(p.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, p.id, coalesce(p."user", '-') AS "user", coalesce(p.host, '-') AS host, coalesce(p.db, '-') AS db,
        {_AGE3} AS age_s, coalesce(p.state, '-') AS state, coalesce(p.info, '-') AS query,
        CASE WHEN {_AGE3} >= 300 THEN 'red' WHEN {_AGE3} >= 120 THEN 'orange' WHEN {_AGE3} >= 60 THEN 'yellow' ELSE 'none' END AS band
    FROM {{sessions}} p LEFT JOIN {{trx}} t ON {_on('p','t')} t.thread_id = p.id
    LEFT JOIN {{threads}} th ON {_on('p','th')} th.processlist_id = p.id
    LEFT JOIN {{trx_events}} e ON {_on('th','e')} e.thread_id = th.thread_id
    WHERE p.id <> 77 AND (t.trx_id IS NOT NULL OR p.command <> 'Sleep') AND {_AGE3} >= 50
    """,
)
def transaction_view(spark, sf_dir):
    f = lambda n: frame(spark, sf_dir, n)
    view = sessions.transaction_view(f("sessions"), f("trx"), f("threads"), f("trx_events"), min_age_s=50, own_id=77)
    return _text_ts(view.withColumn("band", bands.age_band(F.col("age_s"))), "snapshot_ts")


@query(
    "transaction_view_fallback",
    f"""
    SELECT p.server, strftime(p.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, p.id, coalesce(p."user", '-') AS "user", coalesce(p.host, '-') AS host, coalesce(p.db, '-') AS db,
        greatest(coalesce(p.time, 0), coalesce(date_diff('second', t.trx_started, p.snapshot_ts), 0)) AS age_s, coalesce(p.state, '-') AS state, coalesce(p.info, '-') AS query
    FROM {{sessions}} p LEFT JOIN {{trx}} t ON {_on('p','t')} t.thread_id = p.id
    WHERE (t.trx_id IS NOT NULL OR p.command <> 'Sleep')
    """,
)
def transaction_view_fallback(spark, sf_dir):
    return _text_ts(sessions.transaction_view(frame(spark, sf_dir, "sessions"), frame(spark, sf_dir, "trx")), "snapshot_ts")


_FLAT = "replace(replace(replace({c}, chr(10), ' '), chr(13), ''), chr(9), ' ')"


@query(
    "slow_query_view",
    f"""
    SELECT p.server, strftime(p.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, p.id AS conn_id, coalesce(th."user", p."user") AS "user", coalesce(th.db, p.db, '-') AS db,
        coalesce(nullif(th.state, ''), nullif(p.state, ''), th.command, p.command, '-') AS thread_state,
        coalesce(t.trx_id, CAST(e.event_id AS VARCHAR), '-') AS trx_q_id,
        greatest(coalesce(th.time, p.time, 0), coalesce(date_diff('second', t.trx_started, p.snapshot_ts), 0)) AS exec_time,
        strftime(coalesce(t.trx_started, p.snapshot_ts - coalesce(th.time, p.time, 0) * INTERVAL 1 SECOND), '%Y-%m-%d %H:%M:%S') AS start_time,
        coalesce(nullif(e.digest, ''), CASE WHEN coalesce(th.command, p.command) <> 'Sleep' THEN sha256(coalesce(e.sql_text, p.info)) END, '-') AS query_hash,
        coalesce(CASE WHEN coalesce(th.command, p.command) = 'Sleep' THEN CASE WHEN t.trx_id IS NOT NULL THEN '[idle transaction]' ELSE '-' END END,
            nullif({_FLAT.format(c='e.sql_text')}, ''), nullif({_FLAT.format(c='p.info')}, ''), '-') AS query_text
    FROM {{sessions}} p LEFT JOIN {{threads}} th ON {_on('p','th')} th.processlist_id = p.id
    LEFT JOIN {{trx}} t ON {_on('p','t')} t.thread_id = p.id
    LEFT JOIN {{statements}} e ON {_on('th','e')} e.thread_id = th.thread_id
    WHERE (coalesce(th.command, p.command) <> 'Sleep' OR t.trx_id IS NOT NULL)
        AND greatest(coalesce(th.time, p.time, 0), coalesce(date_diff('second', t.trx_started, p.snapshot_ts), 0)) >= 100
    """,
)
def slow_query_view(spark, sf_dir):
    f = lambda n: frame(spark, sf_dir, n)
    return _text_ts(sessions.slow_query_view(f("sessions"), f("threads"), f("trx"), f("statements"), 100), "snapshot_ts")


@query(
    "open_trx_view",
    f"""
    SELECT t.server, strftime(t.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, t.thread_id AS pid, coalesce(p."user", 'internal/system') AS "user", coalesce(p.db, '-') AS db,
        t.trx_state AS state, coalesce(p.time, 0) AS trx_time, coalesce(nullif({_FLAT.format(c='p.info')}, ''), '[idle transaction]') AS query
    FROM {{trx}} t LEFT JOIN {{sessions}} p ON {_on('t','p')} t.thread_id = p.id
    WHERE starts_with(p.db, 'shop') AND p.time >= 20
    """,
)
def open_trx_view(spark, sf_dir):
    view = sessions.open_trx_view(frame(spark, sf_dir, "trx"), frame(spark, sf_dir, "sessions"), db_prefix="shop", min_time=20)
    return _text_ts(view, "snapshot_ts")


@query(
    "lock_wait_view",
    f"""
    SELECT w.server, strftime(w.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, blocking_pid, coalesce(b."user", '-') || '@' || coalesce(b.host, '-') AS blocking_account,
        waiting_pid, coalesce(r."user", '-') || '@' || coalesce(r.host, '-') AS waiting_account, locked_schema || '.' || locked_table AS locked_object,
        wait_age_secs, blocking_query, waiting_query
    FROM {{lock_waits}} w LEFT JOIN {{threads}} b ON {_on('w','b')} b.processlist_id = w.blocking_pid
    LEFT JOIN {{threads}} r ON {_on('w','r')} r.processlist_id = w.waiting_pid WHERE wait_age_secs >= 15
    """,
)
def lock_wait_view(spark, sf_dir):
    return _text_ts(sessions.lock_wait_view(frame(spark, sf_dir, "lock_waits"), frame(spark, sf_dir, "threads"), 15), "snapshot_ts")


@query(
    "lock_wait_sessions",
    f"""
    SELECT w.server, strftime(w.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, blocking_pid AS blk_id, coalesce(b."user", '-') AS blk_user, waiting_pid AS wait_id, coalesce(r."user", '-') AS wait_user,
        locked_schema || '.' || locked_table AS locked_obj, coalesce(r.time, 0) AS wait_time,
        coalesce(nullif({_FLAT.format(c='blocking_query')}, ''), '[idle transaction]') AS blk_query,
        coalesce(nullif({_FLAT.format(c='waiting_query')}, ''), '-') AS wait_query
    FROM {{lock_waits}} w LEFT JOIN {{sessions}} b ON {_on('w','b')} b.id = w.blocking_pid
    LEFT JOIN {{sessions}} r ON {_on('w','r')} r.id = w.waiting_pid
    WHERE (b."user" IN ('app2', 'app9') OR r."user" IN ('app2', 'app9')) AND locked_schema = 'shop' AND r.time >= 10
    """,
)
def lock_wait_sessions(spark, sf_dir):
    view = sessions.lock_wait_sessions(
        frame(spark, sf_dir, "lock_waits"), frame(spark, sf_dir, "sessions"), ["app2", "app9"], "shop", 10
    )
    return _text_ts(view, "snapshot_ts")


@query(
    "locked_transactions",
    f"""
    SELECT w.server, strftime(w.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, strftime(r.trx_wait_started, '%Y-%m-%d %H:%M:%S') AS wait_started,
        date_diff('second', r.trx_wait_started, w.snapshot_ts) AS wait_age_secs, rl.lock_table AS locked_table, rl.lock_index AS locked_index, rl.lock_type AS locked_type,
        r.trx_id AS waiting_trx_id, date_diff('second', r.trx_started, w.snapshot_ts) AS waiting_trx_age_secs, r.rows_locked AS waiting_trx_rows_locked,
        r.rows_modified AS waiting_trx_rows_modified, r.thread_id AS waiting_pid, r.query AS waiting_query, rl.lock_mode AS waiting_lock_mode,
        b.trx_id AS blocking_trx_id, b.thread_id AS blocking_pid, b.query AS blocking_query, bl.lock_mode AS blocking_lock_mode,
        date_diff('second', b.trx_started, w.snapshot_ts) AS blocking_trx_age_secs, b.rows_locked AS blocking_trx_rows_locked, b.rows_modified AS blocking_trx_rows_modified,
        'KILL QUERY ' || b.thread_id AS sql_kill_blocking_query, 'KILL ' || b.thread_id AS sql_kill_blocking_connection
    FROM {{lock_waits}} w JOIN {{trx}} b ON {_on('w','b')} b.trx_id = w.blocking_trx_id JOIN trx r ON {_on('w','r')} r.trx_id = w.requesting_trx_id
    JOIN {{locks}} bl ON {_on('w','bl')} bl.lock_id = w.blocking_lock_id JOIN locks rl ON {_on('w','rl')} rl.lock_id = w.requested_lock_id
    """,
)
def locked_transactions(spark, sf_dir):
    f = lambda n: frame(spark, sf_dir, n)
    return _text_ts(sessions.locked_transactions(f("lock_waits"), f("trx"), f("locks")), "snapshot_ts", "wait_started")


@query(
    "open_trx_history",
    f"""
    SELECT t.server, strftime(t.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, p.id AS process_id, p."user" AS username, h.event_id, h.event_name,
        date_diff('second', t.trx_started, t.snapshot_ts) AS running_s, h.sql_text
    FROM {{trx}} t JOIN {{sessions}} p ON {_on('t','p')} t.thread_id = p.id JOIN {{threads}} th ON {_on('t','th')} th.processlist_id = t.thread_id
    JOIN {{statements}} h ON {_on('th','h')} h.thread_id = th.thread_id
    WHERE date_diff('second', t.trx_started, t.snapshot_ts) > 10 AND p."user" <> 'SYSTEM_USER'
    """,
)
def open_trx_history(spark, sf_dir):
    f = lambda n: frame(spark, sf_dir, n)
    return _text_ts(sessions.open_trx_history(f("trx"), f("sessions"), f("threads"), f("statements")), "snapshot_ts")


@query(
    "last_statement_of_trx",
    """
    SELECT server, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, thread_id, e.event_id AS trx_event_id, ((e.timer_wait + 500000000) // 1000000000) / 1000.0::DOUBLE AS trx_runtime,
        s.current_schema AS db, s.sql_text AS query, rows_examined, rows_affected, CASE WHEN end_event_id IS NULL THEN 'running' ELSE 'done' END AS exec_state,
        ((s.timer_wait + 500000000) // 1000000000) / 1000.0::DOUBLE AS exec_time, processlist_id AS process_id, th."user" AS username, th.host AS user_host
    FROM {trx_events} e JOIN {statements} s USING (server, snapshot_ts, thread_id) JOIN {threads} th USING (server, snapshot_ts, thread_id)
    WHERE e.state = 'ACTIVE' AND e.timer_wait > 1000000000000
    """,
)
def last_statement_of_trx(spark, sf_dir):
    f = lambda n: frame(spark, sf_dir, n)
    return _text_ts(sessions.last_statement_of_trx(f("trx_events"), f("statements"), f("threads")), "snapshot_ts")


@query(
    "long_running_trx",
    f"""
    SELECT t.server, strftime(t.snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, trx_id, t.thread_id AS process_id,
        strftime(t.trx_started + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS trx_started, date_diff('second', t.trx_started, t.snapshot_ts) AS trx_runtime_s,
        trx_state, rows_locked, rows_modified, query, concat_ws('@', p."user", p.host) AS fullusername
    FROM {{trx}} t JOIN {{sessions}} p ON {_on('t','p')} t.thread_id = p.id WHERE date_diff('second', t.trx_started, t.snapshot_ts) > 1
    """,
)
def long_running_trx(spark, sf_dir):
    view = sessions.long_running_trx(frame(spark, sf_dir, "trx"), frame(spark, sf_dir, "sessions"), 1, "+03:00")
    return _text_ts(view, "snapshot_ts", "trx_started")


@query(
    "members_without_hidden_flag",
    """
    SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE NOT regexp_matches(c_name, '7$') AND NOT regexp_matches(c_name, '^Customer#0+3') AND NOT (c_mktsegment = 'MACHINERY' AND c_acctbal IS NULL)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND n_name IN ('NATION_1', 'NATION_3', 'NATION_4')
    """,
)
def members_without_hidden_flag(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    hidden = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    kept = t("customer").filter(
        ~F.col("c_name").rlike("7$") & ~F.col("c_name").rlike("^Customer#0+3")
        & ~((F.col("c_mktsegment") == "MACHINERY") & F.col("c_acctbal").isNull())
    )
    nations = t("nation").filter(F.col("n_name").isin("NATION_1", "NATION_3", "NATION_4"))
    return (
        kept.join(hidden, "c_custkey", "left_anti")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "n_name", "r_name")
    )


_PROXY = """"user" NOT IN ('admin', 'radmin', 'monitor', 'proxysql')"""


@query(
    "proxy_connections",
    f"""
    SELECT "user", cli_host, coalesce(srv_host, 'N/A') AS srv_host, coalesce(db, 'N/A') AS db, false AS is_total, count(*) AS connections, count(*) >= 40 AS over
    FROM {{proxy_sessions}} WHERE {_PROXY} GROUP BY "user", cli_host, proxy_sessions.srv_host, proxy_sessions.db
    UNION ALL SELECT 'GLOBAL TOTALS', '', '', '', true, count(*), count(*) >= 40 FROM proxy_sessions WHERE {_PROXY}
    """,
)
def proxy_connections(spark, sf_dir):
    out = proxy.proxy_connections(frame(spark, sf_dir, "proxy_sessions"), "count")
    return out.withColumn("over", bands.over_threshold(F.col("connections"), 40))


@query(
    "proxy_active_queries",
    f"""
    SELECT session_id, hostgroup, "user", cli_host, coalesce(srv_host, 'Pending') AS srv_host, time_ms,
        trim(regexp_replace(regexp_replace(info, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g'), '\\s+', ' ', 'g')) AS query,
        CASE WHEN time_ms > 1000 THEN 'red' WHEN time_ms > 500 THEN 'yellow' ELSE 'cyan' END AS band
    FROM {{proxy_sessions}} WHERE {_PROXY} AND info IS NOT NULL AND info <> ''
    """,
)
def proxy_active_queries(spark, sf_dir):
    return proxy.active_queries(frame(spark, sf_dir, "proxy_sessions"))


_DIGEST = """SELECT regexp_replace(info, '[0-9]+', '?', 'g') AS digest_text, count(*) AS count_star, CAST(sum(time_ms) AS BIGINT) AS sum_time, min(time_ms) AS min_time, max(time_ms) AS max_time,
    '0x' || upper(substr(md5(regexp_replace(info, '[0-9]+', '?', 'g')), 1, 16)) AS digest FROM {proxy_sessions} WHERE info <> '' GROUP BY 1"""


def _digest(spark, sf_dir):
    rows = frame(spark, sf_dir, "proxy_sessions").filter("info <> ''")
    return proxy.digest(rows, F.regexp_replace("info", "[0-9]+", "?"), F.col("time_ms"))


@query("query_digest", _DIGEST)
def query_digest(spark, sf_dir):
    return _digest(spark, sf_dir)


@query(
    "query_digest_top",
    """SELECT info AS digest_text, count(*) AS count_star, CAST(sum(time_ms) AS BIGINT) AS sum_time, min(time_ms) AS min_time, max(time_ms) AS max_time,
    '0x' || upper(substr(md5(info), 1, 16)) AS digest FROM {proxy_sessions} WHERE info <> '' GROUP BY info ORDER BY sum_time DESC, digest LIMIT 15""",
)
def query_digest_top(spark, sf_dir):
    rows = frame(spark, sf_dir, "proxy_sessions").filter("info <> ''")
    return proxy.digest_top(proxy.digest(rows, F.col("info"), F.col("time_ms")))


FRAMES["proxy_pool"] = """
SELECT CAST(s_suppkey % 5 AS INT) AS hostgroup, concat('backend', CAST(s_suppkey AS STRING), ':3306') AS srv_host,
       CASE s_nationkey % 5 WHEN 0 THEN 'ONLINE' WHEN 1 THEN ' shunned ' WHEN 2 THEN 'OFFLINE_SOFT' WHEN 3 THEN 'OFFLINE_HARD' ELSE 'lost' END AS status,
       s_suppkey % 40 AS conn_used
FROM {supplier}
"""


@query(
    "proxy_pool_status",
    """SELECT *, CASE upper(trim(status)) WHEN 'ONLINE' THEN 'green' WHEN 'SHUNNED' THEN 'yellow' WHEN 'OFFLINE_SOFT' THEN 'orange' ELSE 'red' END AS band FROM {proxy_pool}""",
)
def proxy_pool_status(spark, sf_dir):
    return proxy.pool_status(frame(spark, sf_dir, "proxy_pool"))


FRAMES["proxy_pings"] = """
SELECT concat('proxy', CAST(l_suppkey % 6 AS STRING)) AS server, concat('backend', CAST(l_suppkey AS STRING), '-', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS hostname,
       1704067200000000 + l_orderkey * 1000003 + l_linenumber AS time_start_us, l_partkey AS ping_success_time_us,
       CASE l_linenumber WHEN 1 THEN 'timeout' WHEN 2 THEN ' null ' WHEN 3 THEN NULL ELSE '' END AS ping_error
FROM {lineitem}
"""


@query(
    "recent_pings",
    """SELECT server, hostname, strftime(make_timestamp(time_start_us), '%Y-%m-%d %H:%M:%S.%f') AS last_ping, ping_success_time_us, ping_error,
        upper(trim(coalesce(ping_error, ''))) IN ('', 'NULL') AS ok FROM {proxy_pings}
        QUALIFY row_number() OVER (PARTITION BY server ORDER BY time_start_us DESC, hostname) <= 8""",
)
def recent_pings(spark, sf_dir):
    pings = proxy.recent_pings(frame(spark, sf_dir, "proxy_pings"), 8)
    return pings.withColumn("last_ping", F.date_format("last_ping", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


FRAMES["pool_stats"] = """
SELECT concat('db', CAST(CAST(floor(o_orderkey / 4) AS BIGINT) % 50 AS STRING)) AS server, date_trunc('month', o_orderdate) AS snapshot_ts,
       20000 AS pool_size, o_custkey AS free_buffers, CASE WHEN o_orderkey % 40 < 4 THEN 0 ELSE o_custkey + 1000 END AS database_pages,
       CASE WHEN o_orderkey % 40 < 4 THEN 0 ELSE o_custkey % 700 END AS modified_database_pages, o_custkey * 2 AS pages_read_rate, o_custkey * 3 AS pages_made_young, o_custkey AS pages_not_made_young
FROM {orders}
"""


@query(
    "pool_global",
    """
    SELECT server, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, CAST(sum(pool_size) AS BIGINT) AS pool_size, CAST(sum(free_buffers) AS BIGINT) AS free_buffers, CAST(sum(database_pages) AS BIGINT) AS database_pages,
        CAST(sum(modified_database_pages) AS BIGINT) AS modified_database_pages, CAST(sum(pages_read_rate) AS BIGINT) AS pages_read_rate, CAST(sum(pages_made_young) AS BIGINT) AS pages_made_young,
        CAST(sum(pages_not_made_young) AS BIGINT) AS pages_not_made_young,
        CASE WHEN sum(database_pages) > 0 THEN ((sum(modified_database_pages) * 20000 + sum(database_pages)) // (2 * sum(database_pages))) / 100.0::DOUBLE END AS dirty_pct,
        CASE WHEN sum(pages_read_rate) > 5000 THEN 'red' WHEN sum(pages_read_rate) > 0 THEN 'yellow' ELSE 'none' END AS io_band
    FROM {pool_stats} GROUP BY server, snapshot_ts
    """,
)
def pool_global(spark, sf_dir):
    return _text_ts(pool.pool_global(frame(spark, sf_dir, "pool_stats")), "snapshot_ts")


FRAMES["buffer_pages"] = """
SELECT concat('`shop`.`part', CAST(l_partkey % 20 AS STRING), '`') AS table_name, concat('idx', CAST(l_suppkey % 30 AS STRING)) AS index_name,
       CAST(floor(l_extendedprice) AS BIGINT) % 16384 AS data_size, CASE WHEN l_returnflag = 'A' THEN 'YES' ELSE 'NO' END AS is_old,
       CASE WHEN l_linestatus = 'F' THEN 'YES' ELSE 'NO' END AS is_hashed
FROM {lineitem}
"""


@query(
    "pages_by_index",
    """
    SELECT index_name, count(*) AS pages, round(count(*) * 16384 / 1048576.0::DOUBLE, 2) AS allocated_mib, round(sum(data_size) / 1048576.0::DOUBLE, 2) AS data_mib,
        count(*) FILTER (is_old = 'YES') AS old_pages, count(*) FILTER (is_hashed = 'YES') AS hashed_pages
    FROM {buffer_pages} WHERE contains(table_name, 'part1') GROUP BY index_name
    """,
)
def pages_by_index(spark, sf_dir):
    return pool.pages_by_index(frame(spark, sf_dir, "buffer_pages"), "part1")


FRAMES["buffer_tables"] = """
SELECT concat('part', CAST(l_partkey AS STRING)) AS object_name, count(*) AS pages, count(*) * 16384 AS allocated, CAST(sum(l_suppkey) AS BIGINT) AS data,
       CAST(sum(l_linenumber) AS BIGINT) AS pages_old, CAST(min(l_linenumber) AS BIGINT) AS pages_hashed, max(l_orderkey) AS rows_cached, l_returnflag AS phase
FROM {lineitem} GROUP BY l_partkey, l_returnflag
"""


@query(
    "pool_impact",
    """
    WITH u AS (UNPIVOT (SELECT object_name, pages, allocated, data, pages_old, pages_hashed, rows_cached, phase FROM {buffer_tables} WHERE phase IN ('A', 'R'))
        ON pages, allocated, data, pages_old, pages_hashed, rows_cached INTO NAME metric VALUE v)
    SELECT object_name, metric, coalesce(max(v) FILTER (phase = 'A'), 0) AS before, coalesce(max(v) FILTER (phase = 'R'), 0) AS after,
        coalesce(max(v) FILTER (phase = 'R'), 0) - coalesce(max(v) FILTER (phase = 'A'), 0) AS change
    FROM u GROUP BY object_name, metric
    """,
)
def pool_impact(spark, sf_dir):
    tables = frame(spark, sf_dir, "buffer_tables")
    return pool.impact(tables.filter("phase = 'A'"), tables.filter("phase = 'R'"))


@query(
    "pool_top_objects",
    """SELECT 'shop.' || object_name AS object, pages, allocated, data FROM {buffer_tables} WHERE phase = 'N' AND contains('shop.' || object_name, 'part1')
       ORDER BY allocated DESC, object LIMIT 25""",
)
def pool_top_objects(spark, sf_dir):
    tables = frame(spark, sf_dir, "buffer_tables").filter("phase = 'N'").withColumn("object_schema", F.lit("shop"))
    return pool.top_objects(tables, 25, "part1").select("object", "pages", "allocated", "data")


@query(
    "pool_active_statements",
    """SELECT id, "user", time, state, info AS current_statement FROM {sessions}
       WHERE "user" NOT IN ('mysql.session', 'mysql.sys') AND info IS NOT NULL AND contains("user", 'app') ORDER BY time DESC, id LIMIT 50""",
)
def pool_active_statements(spark, sf_dir):
    return pool.active_statements(frame(spark, sf_dir, "sessions").withColumnRenamed("info", "current_statement"), 50, "app")


@query(
    "status_pivot",
    """SELECT server, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, max(value) FILTER (name = 'com_click') AS com_click, max(value) FILTER (name = 'com_error') AS com_error
       FROM {counters} WHERE name IN ('com_click', 'com_error') GROUP BY server, ts""",
)
def status_pivot(spark, sf_dir):
    wide = pool.status_pivot(frame(spark, sf_dir, "counters"), ["com_click", "com_error"])
    return wide.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "counters_by_pattern",
    """SELECT name, count(*) AS samples, max(value) AS top FROM {counters} WHERE name LIKE '%sign%' OR name LIKE 'com_p%' GROUP BY name""",
)
def counters_by_pattern(spark, sf_dir):
    rows = frame(spark, sf_dir, "counters").filter(filters.name_like(F.col("name"), "%sign%", "com_p%"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("top"))


FRAMES["resize"] = """
SELECT concat('db', CAST(user_id AS STRING)) AS server, ts, CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(event_id % 9 AS STRING) END AS resize_code,
       CASE WHEN event_id % 13 = 0 THEN 'x' ELSE CAST(event_id % 150 AS STRING) END AS resize_progress,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id * event_id * 1024 AS STRING) END AS pool_bytes
FROM {events}
"""
_STAGE = """CASE resize_code WHEN '0' THEN 'No resize in progress' WHEN '1' THEN 'Starting resize' WHEN '2' THEN 'Disabling AHI' WHEN '3' THEN 'Withdrawing blocks'
    WHEN '4' THEN 'Acquiring global lock' WHEN '5' THEN 'Resizing pool' WHEN '6' THEN 'Resizing hash' WHEN '7' THEN 'Resize failed' ELSE 'Numeric resize status unavailable' END"""


@query(
    "resize_status",
    f"""
    SELECT server, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, {_STAGE} AS stage,
        CASE WHEN regexp_matches(resize_code, '^[0-7]$') AND regexp_matches(resize_progress, '^[0-9]+$') THEN CAST(least(CAST(resize_progress AS INT), 100) AS VARCHAR) ELSE 'N/A' END AS progress,
        CASE WHEN b IS NULL THEN 'N/A' WHEN b >= 1099511627776 THEN printf('%.2f TiB', b / 1099511627776) WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824)
             WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024) ELSE printf('%.0f B', b) END AS target
    FROM (SELECT *, CAST(pool_bytes AS DOUBLE) AS b FROM {{resize}})
    """,
)
def resize_status(spark, sf_dir):
    out = pool.resize_status(frame(spark, sf_dir, "resize"))
    return out.select("server", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "stage", "progress", "target")


@query(
    "resize_outcome",
    f"""
    SELECT server, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, resize_code, {_STAGE} AS stage,
        CASE resize_code WHEN '0' THEN 'DONE' WHEN '7' THEN 'FAILED' ELSE 'RUNNING' END AS outcome
    FROM (SELECT server, max(ts) AS ts, max_by(resize_code, ts) AS resize_code FROM {{resize}} GROUP BY server)
    """,
)
def resize_outcome(spark, sf_dir):
    return pool.resize_outcome(frame(spark, sf_dir, "resize")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


FRAMES["doc_ops"] = """
SELECT event_id AS connectionId, CASE WHEN user_id % 9 = 0 THEN NULL WHEN user_id % 9 = 1 THEN '127.0.0.1:5' ELSE concat('10.2.0.', CAST(user_id AS STRING)) END AS client,
       CASE WHEN user_id % 6 = 0 THEN NULL ELSE concat('app', CAST(user_id % 6 AS STRING)) END AS appName,
       CASE WHEN user_id % 8 = 0 THEN NULL ELSE concat('db', CAST(event_id % 4 AS STRING), '.coll.', event_type) END AS ns,
       CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS op,
       CASE WHEN event_id % 5 = 0 THEN 'conn' ELSE 'conn12' END AS "desc", event_id % 7 <> 0 AS active,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS secs_running
FROM {events}
""".replace('"desc"', "descr")


def _doc_ops(spark, sf_dir):
    return frame(spark, sf_dir, "doc_ops").withColumnRenamed("descr", "desc")


@query(
    "doc_summary",
    """
    WITH a AS (SELECT coalesce(appName, 'Unknown') AS app, op, split_part(ns, '.', 1) AS db, coalesce(secs_running, 0) AS s FROM {doc_ops} WHERE active AND descr <> 'conn'),
    o AS (SELECT app, string_agg(op || '=' || n, ',' ORDER BY op) AS operations FROM (SELECT app, op, count(*) AS n FROM a GROUP BY ALL) GROUP BY app),
    d AS (SELECT app, string_agg(db || '=' || n, ',' ORDER BY db) AS databases FROM (SELECT app, db, count(*) AS n FROM a WHERE db IS NOT NULL GROUP BY ALL) GROUP BY app)
    SELECT app, count(*) AS total_connections, CAST(sum(s) AS BIGINT) AS total_running_secs, round(sum(s) / count(*)::DOUBLE, 2) AS avg_secs, operations, databases
    FROM a JOIN o USING (app) JOIN d USING (app) GROUP BY app, operations, databases
    """,
)
def doc_summary(spark, sf_dir):
    out = documents.doc_summary(_doc_ops(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return out.select("app", "total_connections", "total_running_secs", "avg_secs", text("operations"), text("databases"))


@query(
    "doc_active",
    """SELECT connectionId, client, op, active AND secs_running > 10 AS long_running FROM {doc_ops} WHERE active AND descr <> 'conn' AND op <> 'none' AND NOT starts_with(coalesce(client, ''), '127.0.0.1')""",
)
def doc_active(spark, sf_dir):
    rows = filters.doc_active(_doc_ops(spark, sf_dir))
    return rows.select("connectionId", "client", "op", (F.col("active") & (F.col("secs_running") > 10)).alias("long_running"))


@query(
    "doc_long_running",
    """SELECT connectionId, secs_running, split_part(ns, '.', 1) AS db FROM {doc_ops} WHERE secs_running > 100 AND active""",
)
def doc_long_running(spark, sf_dir):
    rows = filters.doc_long_running(_doc_ops(spark, sf_dir), 100)
    return rows.select("connectionId", "secs_running", docs.namespace_db(F.col("ns")).alias("db"))


@query(
    "doc_by_runtime",
    """SELECT row_number() OVER (ORDER BY secs_running DESC, connectionId) AS rank, connectionId, client, coalesce(appName, 'Unknown') AS app, coalesce(ns, 'N/A') AS ns, op, secs_running
       FROM {doc_ops} WHERE active AND descr <> 'conn' AND secs_running IS NOT NULL ORDER BY 1 LIMIT 100""",
)
def doc_by_runtime(spark, sf_dir):
    return documents.doc_by_runtime(_doc_ops(spark, sf_dir), 100).withColumn("rank", F.col("rank").cast("long"))


@query(
    "counter_bands",
    """SELECT event_id, CASE WHEN n >= 500000 THEN 'red' WHEN n >= 100000 THEN 'yellow' ELSE 'green' END AS hll, CASE WHEN n >= 10000 THEN 'CRITICAL' WHEN n >= 1000 THEN 'WARNING' ELSE 'OK' END AS locked,
       ((n * 1000000007 + 500000000) // 1000000000) / 1000.0::DOUBLE AS seconds FROM (SELECT event_id, event_id * 37 AS n FROM events)""",
)
def counter_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37).alias("n"))
    return rows.select(
        "event_id", bands.hll_band(F.col("n")).alias("hll"), bands.rows_locked_alert(F.col("n")).alias("locked"),
        units.ps_to_seconds(F.col("n") * 1000000007).alias("seconds"),
    )


@query(
    "session_totals",
    """SELECT server, count(*) AS sessions, count(*) FILTER ("user" IN ('app3', 'app5') AND db = 'shop_1') AS matching, count(*) FILTER (command <> 'Sleep') AS running FROM {sessions} GROUP BY server""",
)
def session_totals(spark, sf_dir):
    matching = F.col("user").isin("app3", "app5") & (F.col("db") == "shop_1")
    return frame(spark, sf_dir, "sessions").groupBy("server").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(matching).alias("matching"), F.count_if(F.col("command") != "Sleep").alias("running")
    )


@query(
    "doc_command_types",
    """SELECT json_keys(props)[1] AS command, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def doc_command_types(spark, sf_dir):
    command = docs.command_type(F.from_json("props", "map<string,string>"))
    return table(spark, sf_dir, "events").groupBy(command.alias("command"), "event_type").agg(F.count(F.lit(1)).alias("n"))
