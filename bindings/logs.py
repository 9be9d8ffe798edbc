"""General log, engine status samples, row-change log and the incident reports over them."""

from pyspark.sql import functions as F

from bindings.registry import FRAMES, frame, query
from opslens.functions import statements as st
from opslens.plans.staging import settled
from opslens.session import checkpointed, scratch_dir
from opslens.sources import logs
from opslens.operators import binlog, engine_status, general_log, incidents, proxy, reports, timeline

# --- general log: one JSON entry per event, some of them broken ---------------------------------

_HEAD = """concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z', chr(92), 't', 'app', CAST(user_id AS STRING), '[app', CAST(user_id AS STRING),
    '] @  [10.3.0.', CAST(user_id % 9 AS STRING), ']', CAST(event_id + 100 AS STRING), ' 73 ')"""

FRAMES["log_lines"] = """
SELECT event_id, CASE event_id %% 9
    WHEN 0 THEN concat('{"textPayload": "', head, 'Query', chr(92), 't', 'SELECT ', event_type, '"}')
    WHEN 1 THEN concat('{"jsonPayload": {"message": "', head, 'Quit', '"}}')
    WHEN 2 THEN concat('{"jsonPayload": {"message": 5, "query": "', head, 'Binlog Dump GTID   x', '"}}')
    WHEN 3 THEN '{"textPayload": "   "}'
    WHEN 4 THEN concat('{"textPayload": "', replace(head, 'Z', ' Z'), 'Query', '"}')
    WHEN 5 THEN concat('{"textPayload": 12, "jsonPayload": {"textPayload": "', head, 'Connect Out', '"}}')
    WHEN 6 THEN '{not-json'
    WHEN 7 THEN concat('{"textPayload": "  ', head, 'Query', chr(92), 't', 'SELECT 1', chr(92), 'n', 'FROM ', event_type, ' ', chr(92), 'n', '"}')
    ELSE concat('{"textPayload": "', head, 'Register', chr(92), 't', ' Replica 7', '"}') END AS line
FROM (SELECT *, %s AS head FROM {events})
""" % _HEAD

_KIND = """CASE event_id % 9 WHEN 0 THEN 'Query' WHEN 1 THEN 'Quit' WHEN 2 THEN 'Binlog Dump GTID' WHEN 5 THEN 'Connect Out' WHEN 7 THEN 'Query' WHEN 8 THEN 'Register Replica' END"""
_ARG = """CASE event_id % 9 WHEN 0 THEN 'SELECT ' || event_type WHEN 2 THEN 'x' WHEN 7 THEN 'SELECT 1' || chr(10) || 'FROM ' || event_type WHEN 8 THEN '7' ELSE '' END"""


def _entries(spark, sf_dir):
    lines = settled(frame(spark, sf_dir, "log_lines", dealt=True), entry=F.try_parse_json("line")).drop("line")
    return lines.withColumn("error", F.when(F.col("entry").isNull(), "invalid JSON"))


@query(
    "general_log_accepted",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time, 'app' || user_id || '@10.3.0.' || (user_id % 9) AS user_host, event_id + 100 AS thread_id,
        73 AS server_id, {_KIND} AS command_type, {_ARG} AS argument FROM events WHERE {_KIND} IS NOT NULL""",
)
def general_log_accepted(spark, sf_dir):
    accepted, _ = general_log.parse_general_log(_entries(spark, sf_dir))
    return accepted.select(
        "event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"), "user_host",
        F.col("thread_id").cast("long").alias("thread_id"), F.col("server_id").cast("long").alias("server_id"), "command_type", "argument",
    )


@query(
    "general_log_rejected",
    """SELECT event_id, CASE event_id % 9 WHEN 3 THEN 'empty payload' WHEN 4 THEN 'payload format mismatch' ELSE 'invalid JSON' END AS reason FROM events WHERE event_id % 9 IN (3, 4, 6)""",
)
def general_log_rejected(spark, sf_dir):
    _, rejected = general_log.parse_general_log(_entries(spark, sf_dir))
    return rejected.select("event_id", "reason")


@query(
    "general_log_activity",
    f"""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'app' || user_id || '@10.3.0.' || (user_id % 9) AS user_host, {_KIND} AS command_type, count(*) AS entries
        FROM events WHERE {_KIND} IS NOT NULL GROUP BY ALL""",
)
def general_log_activity(spark, sf_dir):
    accepted, _ = general_log.parse_general_log(_entries(spark, sf_dir))
    activity = general_log.general_log_activity(accepted, window="6 hours")
    return activity.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "general_log_activity_sliding",
    f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, {_KIND} AS command_type, count(*) AS entries
        FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events)
        WHERE {_KIND} IS NOT NULL GROUP BY ALL""",
)
def general_log_activity_sliding(spark, sf_dir):
    accepted, _ = general_log.parse_general_log(_entries(spark, sf_dir))
    activity = general_log.general_log_activity(accepted, ["command_type"], "2 hours", "1 hour")
    return activity.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "general_log_from_table",
    """SELECT event_id AS thread_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time, event_type AS command_type, props AS argument, user_id AS server_id, 'u@h' AS user_host FROM events""",
)
def general_log_from_table(spark, sf_dir):
    from bindings.registry import table

    stored = table(spark, sf_dir, "events").withColumn("user_host", F.lit("u@h"))
    out = general_log.general_log_from_table(
        stored, {"ts": "event_time", "event_id": "thread_id", "user_id": "server_id", "event_type": "command_type", "props": "argument"}
    )
    return out.select(
        F.col("thread_id").cast("long").alias("thread_id"), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"),
        "command_type", "argument", F.col("server_id").cast("long").alias("server_id"), "user_host",
    )


# --- engine status samples: one sample per event ------------------------------------------------

# What a sample of an event says; the template is what the statement must be reduced to.
FRAMES["sample_facts"] = """
SELECT event_id, date_trunc('hour', ts) AS file_hour, date_trunc('second', ts) AS sample_ts,
       date_trunc('second', ts) - (event_id % 5) * INTERVAL '3000' SECOND AS deadlock_ts,
       event_type = 'error' AS has_deadlock, event_type IN ('click', 'purchase') AS is_lock,
       concat('u', CAST(user_id % 7 AS STRING)) AS usr, concat('host', CAST(user_id % 3 AS STRING)) AS hst,
       CAST(user_id + 10 AS STRING) AS thread, CAST(event_id + 5000 AS STRING) AS trx,
       CASE CAST(user_id % 4 AS INT)
           WHEN 0 THEN concat('UPDATE item', CAST(user_id % 3 AS STRING), ' SET qty=', CAST(event_id AS STRING), ' WHERE id IN (', CAST(user_id AS STRING), ', -3.5,7) AND note = ''it\\\\''s ', event_type, '''')
           WHEN 1 THEN concat('insert into log', CAST(user_id % 2 AS STRING), ' values (', CAST(event_id AS STRING), ', NULL, ''2024-01-01 10:00:00'', 0xFF, true)')
           WHEN 2 THEN concat('DELETE FROM cart WHERE ts<2024-01-02 AND u > ', CAST(user_id AS STRING), ' AND n = "x"')
           ELSE concat('call refresh(', CAST(user_id AS STRING), ')') END AS query,
       CASE CAST(user_id % 4 AS INT)
           WHEN 0 THEN concat('UPDATE item', CAST(user_id % 3 AS STRING), ' SET qty = ? WHERE id IN (?, ?, ?) AND note = ?')
           WHEN 1 THEN concat('insert into log', CAST(user_id % 2 AS STRING), ' values (?, ?, ?, ?, ?) ')
           WHEN 2 THEN 'DELETE FROM cart WHERE ts < ? AND u > ? AND n = ?'
           END AS template,
       CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'DELETE' END AS op
FROM {events}
""".replace("''it\\\\''s ", "''its ")

FRAMES["samples"] = """
SELECT event_id, file_hour, concat('=====', chr(10), CAST(sample_ts AS STRING), ' 0x7f INNODB MONITOR OUTPUT', chr(10),
    CASE WHEN has_deadlock THEN concat('LATEST DETECTED DEADLOCK', chr(10), '------------------------', chr(10), CAST(deadlock_ts AS STRING), ' 0x7f11', chr(10),
        '*** (1) TRANSACTION:', chr(10), 'TRANSACTION ', trx, ', ACTIVE 5 sec starting index read', chr(10), 'mysql tables in use 1, locked 1', chr(10), 'LOCK WAIT 3 lock struct(s)', chr(10),
        'MySQL thread id ', thread, ', OS thread handle 123, query id 9 ', hst, ' ', usr, ' updating', chr(10), '  ', query, chr(10), '*** WE ROLL BACK TRANSACTION (1)', chr(10)) ELSE '' END,
    '------------', chr(10), 'TRANSACTIONS', chr(10), '------------', chr(10), 'Trx id counter 99', chr(10), '---TRANSACTION 421, not started', chr(10), '0 lock struct(s), heap size 1136, 0 row lock(s)', chr(10),
    '---TRANSACTION ', trx, ', ACTIVE ', CAST(event_id % 50 AS STRING), ' sec', chr(10),
    CASE WHEN is_lock THEN concat('mysql tables in use 1, locked 1', chr(10), 'LOCK WAIT 2 lock struct(s), heap size 1136, ', CAST(event_id * 3 AS STRING), ' row lock(s)', chr(10),
            'MySQL thread id ', thread, ', OS thread handle 123, query id 5 ', hst, ' ', usr, ' updating', chr(10), query, chr(10))
         ELSE concat('3 lock struct(s), heap size 1136, ', CAST(event_id * 3 AS STRING), ' row lock(s)', chr(10),
            'MySQL thread id ', thread, ', OS thread handle 123, query id 5 ', hst, ' ', usr, ' init', chr(10), query, chr(10)) END,
    '--------', chr(10), 'FILE I/O', chr(10), '--------', chr(10), 'I/O thread 0 state: waiting', chr(10)) AS text
FROM {sample_facts}
"""

# The rows a correct parse must give.
FRAMES["incident_rows"] = """
SELECT event_id, 'DEADLOCK' AS type, deadlock_ts AS ts, usr, hst, thread, trx, op, template FROM {sample_facts}
WHERE has_deadlock AND op IS NOT NULL AND file_hour - INTERVAL '9000' SECOND <= deadlock_ts
UNION ALL
SELECT event_id, CASE WHEN is_lock THEN 'LOCK' ELSE 'ACTIVE' END, sample_ts, usr, hst, thread, trx, op, template FROM {sample_facts} WHERE op IS NOT NULL
"""


def _parsed(spark, sf_dir, mode="full", **options):
    return engine_status.parse_engine_status(frame(spark, sf_dir, "samples", dealt=True), mode, **options)


def _second(name="ts"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_SECOND = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_INCIDENT_COLUMNS = f"""event_id, type, {_SECOND.format('ts')}, usr AS "user", hst AS host, thread, trx, op, template"""


@query("engine_status_full", f"SELECT {_INCIDENT_COLUMNS} FROM {{incident_rows}}")
def engine_status_full(spark, sf_dir):
    return _parsed(spark, sf_dir).select("event_id", "type", _second(), "user", "host", "thread", "trx", "op", "template")


@query(
    "engine_status_filtered",
    f"""SELECT {_INCIDENT_COLUMNS} FROM {{incident_rows}} WHERE type <> 'ACTIVE' AND (regexp_matches(template, 'item.') OR contains(template, 'cart'))
        AND usr = 'u3' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 11:59:59'""",
)
def engine_status_filtered(spark, sf_dir):
    from opslens.sources.logs import sample_range

    start, end = sample_range("2024-01-05", "2024-01-20 11")
    rows = _parsed(spark, sf_dir, "all", tables="item?, cart", users="u3", start=start, end=end)
    return rows.select("event_id", "type", _second(), "user", "host", "thread", "trx", "op", "template")


@query(
    "status_transactions",
    """SELECT event_id, strftime(sample_ts, '%Y-%m-%d %H:%M:%S') AS sample_ts, trx AS trx_id, (event_id % 50) || ' sec' AS running, event_id * 3 AS rows_locked,
        CASE WHEN event_id * 3 >= 10000 THEN 'CRITICAL' WHEN event_id * 3 >= 1000 THEN 'WARNING' ELSE 'OK' END AS alert, query FROM {sample_facts}""",
)
def status_transactions(spark, sf_dir):
    rows = engine_status.status_transactions(frame(spark, sf_dir, "samples", dealt=True))
    return rows.select("event_id", _second("sample_ts"), "trx_id", "running", "rows_locked", "alert", "query")


@query(
    "query_digest_of_statements",
    """SELECT digest_text, count(*) AS count_star, CAST(sum(t) AS BIGINT) AS sum_time, min(t) AS min_time, max(t) AS max_time, '0x' || upper(substr(md5(digest_text), 1, 16)) AS digest
        FROM (SELECT coalesce(template, 'call refresh (?) ') AS digest_text, event_id % 977 AS t FROM {sample_facts}) GROUP BY digest_text""",
)
def query_digest_of_statements(spark, sf_dir):
    """Statements of many texts rolled up under their templates."""
    rows = frame(spark, sf_dir, "sample_facts")
    return proxy.digest(rows, st.sql_template(F.col("query")), F.col("event_id") % 977, [0.5, 0.95]).drop("percentile_times")


# --- incident reports ---------------------------------------------------------------------------

GAP = 1800
_LOCK_SECONDS = f"""ep AS (SELECT template, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= {GAP} THEN 0 ELSE 1 END AS opened FROM {{incident_rows}} WHERE type = 'LOCK' WINDOW w AS (PARTITION BY template ORDER BY ts)),
    en AS (SELECT template, ts, sum(opened) OVER (PARTITION BY template ORDER BY ts, opened DESC ROWS UNBOUNDED PRECEDING) AS n FROM ep),
    es AS (SELECT template, n, date_diff('second', min(ts), max(ts)) AS d FROM en GROUP BY template, n),
    ls AS (SELECT template, CAST(sum(d) AS BIGINT) AS lock_seconds, count(*) AS episodes FROM es GROUP BY template)"""


def _first3(column: str) -> str:
    items = f"(SELECT type, template, {column} AS item, min(ts) AS f FROM incident_rows GROUP BY ALL)"
    return f"""(SELECT type, template, CASE WHEN count(*) > 3 THEN array_to_string(list(item ORDER BY f, item)[1:3], ', ') || ' (+' || (count(*) - 3) || ' more)'
        ELSE string_agg(item, ', ' ORDER BY f, item) END AS shown, string_agg(item, ', ' ORDER BY f, item) AS full_list FROM {items} GROUP BY type, template)"""


_SUMMARY = f"""{_LOCK_SECONDS}, s AS (SELECT type, template, count(*) AS occurrences, {_SECOND.format('min(ts)').replace('AS min(ts)', 'AS first_seen')},
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM incident_rows GROUP BY type, template),
    summary AS (SELECT s.*, u.full_list AS users, h.full_list AS hosts, t.shown AS threads, x.shown AS trxs, CASE WHEN s.type = 'LOCK' THEN coalesce(lock_seconds, 0) ELSE 0 END AS lock_seconds,
        substr(md5(s.template), 1, 12) AS template_hash
    FROM s JOIN {_first3('usr')} u USING (type, template) JOIN {_first3('hst')} h USING (type, template) JOIN {_first3('thread')} t USING (type, template)
    JOIN {_first3('trx')} x USING (type, template) LEFT JOIN ls ON ls.template = s.template)"""


def _extracted(spark, sf_dir, mode="full"):
    """Extracted rows, written once because several aggregations read them."""
    return checkpointed(incidents.dedupe_incidents(_parsed(spark, sf_dir, mode)), "incidents")


def _summary(spark, sf_dir):
    out = incidents.incidents(_extracted(spark, sf_dir), GAP)
    return out.withColumn("first_seen", _second("first_seen")).withColumn("last_seen", _second("last_seen"))


@query("incident_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def incident_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(
    "incident_participants",
    "SELECT type, template, dim, item, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM ("
    + " UNION ALL ".join(f"SELECT type, template, ts, '{d}' AS dim, {c} AS item FROM {{incident_rows}}" for d, c in (("user", "usr"), ("host", "hst"), ("thread", "thread"), ("trx", "trx")))
    + ") GROUP BY ALL",
)
def incident_participants(spark, sf_dir):
    return incidents.participants(_extracted(spark, sf_dir)).withColumn("first", _second("first"))


_PART = "event_id % 3"


@query(
    "incident_summary_per_file",
    f"""WITH ep AS (SELECT {_PART} AS part, template, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= {GAP} THEN 0 ELSE 1 END AS opened
            FROM {{incident_rows}} WHERE type = 'LOCK' WINDOW w AS (PARTITION BY {_PART}, template ORDER BY ts)),
        en AS (SELECT part, template, ts, sum(opened) OVER (PARTITION BY part, template ORDER BY ts, opened DESC ROWS UNBOUNDED PRECEDING) AS n FROM ep),
        es AS (SELECT part, template, n, date_diff('second', min(ts), max(ts)) AS d FROM en GROUP BY ALL),
        ls AS (SELECT part, template, CAST(sum(d) AS BIGINT) AS lock_seconds FROM es GROUP BY ALL),
        s AS (SELECT {_PART} AS part, type, template, count(*) AS occurrences FROM incident_rows GROUP BY ALL)
        SELECT s.*, CASE WHEN type = 'LOCK' THEN coalesce(lock_seconds, 0) ELSE 0 END AS lock_seconds FROM s LEFT JOIN ls USING (part, template)""",
)
def incident_summary_per_file(spark, sf_dir):
    """The third of the samples that an entry comes from stands for its file."""
    rows = checkpointed(_parsed(spark, sf_dir).withColumn("part", F.col("event_id") % 3), "incidents")
    return incidents.incidents(rows, GAP, per=["part"]).select("part", "type", "template", "occurrences", "lock_seconds")


@query(
    "incident_report_files",
    f"SELECT {_PART} AS part, type, template, count(*) AS occurrences FROM {{incident_rows}} GROUP BY ALL",
)
def incident_report_files(spark, sf_dir):
    """The summary per part read back from the published set of reports."""
    rows, root = _parsed(spark, sf_dir).withColumn("part", F.col("event_id") % 3), scratch_dir(spark, "reports")
    reports.write_incident_reports(rows, root, per=["part"])
    read = spark.read.option("header", True).option("escape", '"').csv(reports.report_folder(spark, root, "recap_per_part"))
    return read.select(F.col("part").cast("long").alias("part"), "type", "template", F.col("occurrences").cast("long").alias("occurrences"))


@query(
    "general_log_chronological",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time, {_KIND} AS command_type, row_number() OVER (ORDER BY ts, event_id) AS place
        FROM events WHERE {_KIND} IS NOT NULL""",
)
def general_log_chronological(spark, sf_dir):
    """A newest-first export in the order of its times: the place of an entry is its row number in the sorted frame."""
    accepted, _ = general_log.parse_general_log(_entries(spark, sf_dir), chronological=True)
    placed = timeline.row_numbers(accepted, [], ["event_time", "event_id"], F.unix_micros(F.col("event_time").cast("timestamp")))
    return placed.select("event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"), "command_type", F.col("rn").alias("place"))


@query(
    "incident_top",
    f"""WITH {_SUMMARY} SELECT type, template, row_number() OVER w AS rank FROM summary
        WINDOW w AS (PARTITION BY type ORDER BY CASE WHEN type = 'DEADLOCK' THEN occurrences ELSE lock_seconds END DESC, template) QUALIFY row_number() OVER w <= 3""",
)
def incident_top(spark, sf_dir):
    return incidents.top_incidents(_summary(spark, sf_dir), 3).select("type", "template", F.col("rank").cast("long").alias("rank"))


@query(
    "contention_score",
    f"""WITH {_LOCK_SECONDS}, c AS (SELECT template, count(*) AS occurrences, count(*) FILTER (type = 'DEADLOCK') AS deadlocks FROM incident_rows WHERE type <> 'ACTIVE' GROUP BY template)
        SELECT template, coalesce(lock_seconds, 0) + 30 * deadlocks AS score, coalesce(lock_seconds, 0) AS lock_seconds, deadlocks, occurrences FROM c LEFT JOIN ls USING (template)""",
)
def contention_score(spark, sf_dir):
    return incidents.contention_score(_extracted(spark, sf_dir, "all"), GAP)


_MINUTES = "greatest(1.0::DOUBLE, (epoch_us(max({t})) - epoch_us(min({t}))) / 60000000.0::DOUBLE)"
_PCT = "((total * 20000 + whole) // (2 * whole)) / 100.0::DOUBLE"


@query(
    "operations_overview",
    f"""
    WITH g AS (SELECT {_MINUTES.format(t='ts')} AS minutes, count(*) AS whole FROM {{incident_rows}}),
    o AS (SELECT coalesce(op, 'TOTAL') AS op, count(*) AS total, count(*) FILTER (type = 'DEADLOCK') AS deadlocks, count(*) FILTER (type = 'LOCK') AS locks FROM incident_rows GROUP BY ROLLUP (op))
    SELECT op, total, {_PCT} AS pct, round(total / minutes, 2) AS ops_per_min, deadlocks, locks FROM o, g
    """,
)
def operations_overview(spark, sf_dir):
    return incidents.operations_overview(_parsed(spark, sf_dir))


@query(
    "operations_overview_per_table",
    f"""
    WITH r AS (SELECT *, CASE WHEN contains(lower(template), 'item1') THEN 'ITEM1' WHEN contains(lower(template), 'cart') THEN 'CART' ELSE 'UNKNOWN' END AS table_name FROM {{incident_rows}}),
    g AS (SELECT {_MINUTES.format(t='ts')} AS minutes FROM r),
    o AS (SELECT table_name, op, grouping(table_name) AS gt, grouping(op) AS go, count(*) AS total, count(*) FILTER (type = 'DEADLOCK') AS deadlocks, count(*) FILTER (type = 'LOCK') AS locks FROM r GROUP BY ROLLUP (table_name, op)),
    p AS (SELECT *, max(total) OVER (PARTITION BY table_name, gt) AS whole FROM o)
    SELECT CASE WHEN gt = 1 THEN 'ALL' ELSE table_name END AS table_name, CASE WHEN go = 1 THEN 'TOTAL' ELSE op END AS op, total, {_PCT} AS pct, round(total / minutes, 2) AS ops_per_min, deadlocks, locks FROM p, g
    """,
)
def operations_overview_per_table(spark, sf_dir):
    return incidents.operations_overview(_parsed(spark, sf_dir), ["item1", "cart"])


@query(
    "query_recap",
    f"""SELECT template, count(*) AS occurrences, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
        round(count(*) / {_MINUTES.format(t='ts')}, 2) AS ops_per_min FROM {{incident_rows}} GROUP BY template""",
)
def query_recap(spark, sf_dir):
    out = incidents.query_recap(_parsed(spark, sf_dir))
    return out.withColumn("first_seen", _second("first_seen")).withColumn("last_seen", _second("last_seen"))


_VERB_COUNTS = ", ".join(f"count(*) FILTER (op = '{v}') AS {v.lower()}" for v in st.VERBS)


@query(
    "statement_time_series",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS total, {_VERB_COUNTS.replace('AS insert', 'AS "insert"').replace('AS select', 'AS "select"')}, count(*) FILTER (op NOT IN {st.VERBS}) AS other FROM {{incident_rows}} GROUP BY 1""",
)
def statement_time_series(spark, sf_dir):
    return timeline.op_time_series(_parsed(spark, sf_dir), "day")


@query(
    "statement_time_series_per_table",
    f"""SELECT strftime(ts, '%Y-%m-%d %H:00') AS bucket, CASE WHEN contains(lower(template), 'log') THEN 'LOG' ELSE 'UNKNOWN' END AS table_name, count(*) AS total,
        {_VERB_COUNTS.replace('AS insert', 'AS "insert"').replace('AS select', 'AS "select"')}, count(*) FILTER (op NOT IN {st.VERBS}) AS other FROM {{incident_rows}} GROUP BY 1, 2""",
)
def statement_time_series_per_table(spark, sf_dir):
    from opslens.functions.text import first_mentioned

    return timeline.op_time_series(_parsed(spark, sf_dir), "hour", tables=first_mentioned(F.col("query"), ["log"]))


@query(
    "repeated_texts_blanked",
    f"""SELECT event_id, type, CASE WHEN row_number() OVER (PARTITION BY template ORDER BY event_id, type) = 1 THEN template ELSE '' END AS shown_text FROM {{incident_rows}}""",
)
def repeated_texts_blanked(spark, sf_dir):
    rows = _parsed(spark, sf_dir).withColumn("hash", st.template_hash(F.col("template")))
    return timeline.blank_repeats(rows, "hash", "template", ["event_id", "type"]).select("event_id", "type", "shown_text")


# --- row-change log: one transaction per line item ------------------------------------------------

FRAMES["binlog_facts"] = """
SELECT DISTINCT concat('bin.', CAST(l_suppkey % 7 AS STRING)) AS file,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS transaction_id,
       concat('`shop`.`item', CAST(l_partkey % 12 AS STRING), '`') AS t1, concat('`shop`.`stock', CAST(l_suppkey % 5 AS STRING), '`') AS t2,
       CAST(l_partkey % 6 AS INT) AS n_insert, CAST(l_suppkey % 4 AS INT) AS n_update, CAST(l_orderkey % 3 AS INT) AS n_delete,
       CAST(l_orderkey % 60 AS INT) + 10 AS sec
FROM {lineitem}
"""

FRAMES["binlog_tx"] = """
SELECT file, transaction_id, concat(
    '# at 100', chr(10), '#240101 10:05:', lpad(CAST(sec % 60 AS STRING), 2, '0'), ' server id 1  end_log_pos 120', chr(9), 'Table_map: ', t1, ' mapped to number 7', chr(10),
    '# at 120', chr(10), '#240101 10:05:', lpad(CAST(sec % 60 AS STRING), 2, '0'), ' server id 1  end_log_pos 200', chr(9), 'Write_rows: table id 7 flags: STMT_END_F', chr(10),
    repeat(concat('### INSERT INTO ', t1, chr(10), '### SET', chr(10), '###   @1=5', chr(10)), n_insert),
    '# at 200', chr(10), '#240101 10:05:', lpad(CAST(sec % 60 AS STRING), 2, '0'), ' server id 1  end_log_pos 220', chr(9), 'Table_map: ', t2, ' mapped to number 8', chr(10),
    '# at 220', chr(10), '#240101 10:05:', lpad(CAST(sec % 60 AS STRING), 2, '0'), ' server id 1  end_log_pos 300', chr(9), 'Update_rows: table id 8', chr(10),
    repeat(concat('### UPDATE ', t2, chr(10), '### WHERE', chr(10), '###   @1=5', chr(10), '### SET', chr(10), '###   @1=6', chr(10)), n_update),
    '# at 300', chr(10), '#240101 10:05:', lpad(CAST(sec % 60 AS STRING), 2, '0'), ' server id 1  end_log_pos 320', chr(9), 'Delete_rows: table id 7', chr(10),
    repeat(concat('### DELETE FROM ', t1, chr(10), '### WHERE', chr(10), '###   @1=5', chr(10)), n_delete),
    CASE WHEN n_insert = 5 THEN concat('# at 400', chr(10), '#240101 10:06:00 server id 1 Query', chr(10), 'ALTER TABLE ', t1, ' ADD c INT', chr(10), '### DROP TABLE ', t2, chr(10)) ELSE '' END,
    '# at 500', chr(10), '#240101 10:05:59 server id 1  end_log_pos 600', chr(9), 'Xid = 1') AS text
FROM {binlog_facts}
"""

_STATEMENTS = """
    SELECT file, transaction_id, CAST(0 AS INTEGER) AS event_id, t1 AS table_name, 'INSERT' AS op, CAST(n_insert AS BIGINT) AS rows_affected, sec FROM {binlog_facts} WHERE n_insert > 0
    UNION ALL SELECT file, transaction_id, 1, t2, 'UPDATE', n_update, sec FROM binlog_facts WHERE n_update > 0
    UNION ALL SELECT file, transaction_id, 2, t1, 'DELETE', n_delete, sec FROM binlog_facts WHERE n_delete > 0"""


def _statements(spark, sf_dir, attribute="statement"):
    events = binlog.binlog_events(frame(spark, sf_dir, "binlog_tx", dealt=True))
    return binlog.binlog_statements(events, ("file", "transaction_id"), attribute)


@query(
    "binlog_statements",
    f"WITH s AS ({_STATEMENTS}) SELECT file, transaction_id, event_id, '2024-01-01 10:05:' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS ts, table_name, op, rows_affected FROM s",
)
def binlog_statements(spark, sf_dir):
    return _statements(spark, sf_dir).withColumn("ts", _second("ts"))


@query(
    "binlog_transactions",
    """SELECT file, transaction_id, CAST(n_insert + n_update + n_delete AS BIGINT) AS total, CAST(n_insert AS BIGINT) AS inserts, CAST(n_update AS BIGINT) AS updates, CAST(n_delete AS BIGINT) AS deletes FROM {binlog_facts}""",
)
def binlog_transactions(spark, sf_dir):
    return binlog.binlog_transactions(frame(spark, sf_dir, "binlog_tx", dealt=True)).drop("ts")


@query(
    "binlog_top_tables",
    f"WITH s AS ({_STATEMENTS}) SELECT table_name, op, count(*) AS statements, CAST(sum(rows_affected) AS BIGINT) AS rows_affected FROM s GROUP BY ALL ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 20",
)
def binlog_top_tables(spark, sf_dir):
    return binlog.binlog_top_tables(_statements(spark, sf_dir), k=20)


@query(
    "binlog_deletes_by_table",
    f"WITH s AS ({_STATEMENTS}) SELECT table_name, op, count(*) AS statements, CAST(sum(rows_affected) AS BIGINT) AS rows_affected FROM s WHERE op = 'DELETE' GROUP BY ALL",
)
def binlog_deletes_by_table(spark, sf_dir):
    return binlog.binlog_top_tables(_statements(spark, sf_dir), "delete")


@query(
    "binlog_table_ops",
    f"WITH s AS ({_STATEMENTS}) SELECT op, rows_affected, count(*) AS statements FROM s WHERE table_name = '`shop`.`item3`' GROUP BY ALL",
)
def binlog_table_ops(spark, sf_dir):
    return binlog.binlog_table_ops(_statements(spark, sf_dir), "`shop`.`item3`")


@query(
    "binlog_top_statements",
    f"""WITH s AS ({_STATEMENTS}) SELECT file, transaction_id, event_id, table_name, op, rows_affected FROM s
        QUALIFY row_number() OVER (PARTITION BY file ORDER BY rows_affected DESC, transaction_id, event_id, table_name, op) <= 7""",
)
def binlog_top_statements(spark, sf_dir):
    top = binlog.binlog_top_statements(_statements(spark, sf_dir).drop("ts"))
    return top.select("file", "transaction_id", "event_id", "table_name", "op", "rows_affected")


@query(
    "binlog_ddl",
    """SELECT file, transaction_id, CASE WHEN n_insert = 5 THEN 1 ELSE 0 END::BIGINT AS alters, 0::BIGINT AS creates, CASE WHEN n_insert = 5 THEN 1 ELSE 0 END::BIGINT AS drops,
        CASE WHEN n_insert = 5 THEN 2 ELSE 0 END::BIGINT AS total FROM {binlog_facts} WHERE sec % 60 BETWEEN 20 AND 40""",
)
def binlog_ddl(spark, sf_dir):
    return binlog.binlog_ddl(frame(spark, sf_dir, "binlog_tx", dealt=True), "2024-01-01 10:05:20", "2024-01-01 10:05:40").drop("ts")


# --- the same logs written as files and read by their sources -----------------------------------


def _write_log(rows, path: str, separator: str) -> None:
    """Write a log as rotated, compressed files: its texts repeat themselves, and a compressed file is one split."""
    rows.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", 500_000).text(path)


def _as_files(spark, sf_dir, name: str, column: str, separator: str) -> str:
    path = scratch_dir(spark, f"files-{name}")
    _write_log(frame(spark, sf_dir, name, dealt=True).select(column), path, separator)
    return path


@query(
    "general_log_from_files",
    f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time, 'app' || user_id || '@10.3.0.' || (user_id % 9) AS user_host, event_id + 100 AS thread_id,
        {_KIND} AS command_type, {_ARG} AS argument FROM events WHERE {_KIND} IS NOT NULL""",
)
def general_log_from_files(spark, sf_dir):
    entries = logs.cloud_log(spark, _as_files(spark, sf_dir, "log_lines", "line", "\n"))
    accepted, _ = general_log.parse_general_log(entries)
    time = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time")
    return accepted.select(time, "user_host", F.col("thread_id").cast("long").alias("thread_id"), "command_type", "argument")


@query(
    "general_log_files_summary",
    f"""SELECT CASE WHEN {_KIND} IS NOT NULL THEN 'accepted' WHEN event_id % 9 = 3 THEN 'empty payload' WHEN event_id % 9 = 4 THEN 'payload format mismatch' ELSE 'invalid JSON' END AS outcome, count(*) AS entries
        FROM events GROUP BY 1""",
)
def general_log_files_summary(spark, sf_dir):
    accepted, rejected = general_log.parse_general_log(logs.cloud_log(spark, _as_files(spark, sf_dir, "log_lines", "line", "\n")))
    outcomes = accepted.select(F.lit("accepted").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("entries"))


def _binlog_files(spark, sf_dir) -> str:
    """The row-change log with a position of its own for every event, as in a real file.

    A transaction's events keep their three digits behind a number of the transaction, so their positions are in order.
    """
    path = scratch_dir(spark, "files-binlog")
    own = F.concat(F.lit("# at "), F.pmod(F.xxhash64("file", "transaction_id"), F.lit(9 * 10**15)).cast("string"))
    _write_log(frame(spark, sf_dir, "binlog_tx", dealt=True).select(F.replace("text", F.lit("# at "), own)), path, "\nCOMMIT/*!*/;\n")
    return path


_FILE_STATEMENTS = f"WITH s AS ({_STATEMENTS}) SELECT table_name, op, count(*) AS statements, CAST(sum(rows_affected) AS BIGINT) AS rows_affected FROM s GROUP BY ALL"


@query("binlog_statements_from_files", _FILE_STATEMENTS)
def binlog_statements_from_files(spark, sf_dir):
    records = logs.binlog_text(spark, _binlog_files(spark, sf_dir))
    rows = binlog.binlog_statements(binlog.binlog_events(records), ("file", "transaction_id"))
    return rows.groupBy("table_name", "op").agg(F.count(F.lit(1)).alias("statements"), F.sum("rows_affected").alias("rows_affected"))


@query("binlog_events_from_files", _FILE_STATEMENTS)
def binlog_events_from_files(spark, sf_dir):
    """A record per event: no record grows with its transaction."""
    rows = binlog.binlog_statements(logs.binlog_events_text(spark, _binlog_files(spark, sf_dir)))
    return rows.groupBy("table_name", "op").agg(F.count(F.lit(1)).alias("statements"), F.sum("rows_affected").alias("rows_affected"))


@query(
    "binlog_announced_tables",
    """SELECT table_name, op, count(*) AS statements, CAST(sum(n) AS BIGINT) AS rows_affected FROM (
        SELECT t1 AS table_name, 'INSERT' AS op, n_insert AS n FROM {binlog_facts} WHERE n_insert > 0
        UNION ALL SELECT t2, 'UPDATE', n_update FROM binlog_facts WHERE n_update > 0
        UNION ALL SELECT t2, 'DELETE', n_delete FROM binlog_facts WHERE n_delete > 0) GROUP BY ALL""",
)
def binlog_announced_tables(spark, sf_dir):
    """The deletes follow the announcement of the second table, so a listing by announcements counts them there."""
    rows = binlog.binlog_statements(logs.binlog_events_text(spark, _binlog_files(spark, sf_dir)), attribute="table_map")
    return rows.groupBy("table_name", "op").agg(F.count(F.lit(1)).alias("statements"), F.sum("rows_affected").alias("rows_affected"))


@query(
    "binlog_transactions_from_events",
    """SELECT CAST(n_insert AS BIGINT) AS inserts, CAST(n_update AS BIGINT) AS updates, CAST(n_delete AS BIGINT) AS deletes, CAST(n_insert + n_update + n_delete AS BIGINT) AS total, count(*) AS transactions
        FROM {binlog_facts} GROUP BY ALL""",
)
def binlog_transactions_from_events(spark, sf_dir):
    """Transactions put together from their event records."""
    rows = binlog.binlog_transactions_of_events(logs.binlog_events_text(spark, _binlog_files(spark, sf_dir)))
    return rows.groupBy("inserts", "updates", "deletes", "total").agg(F.count(F.lit(1)).alias("transactions"))
