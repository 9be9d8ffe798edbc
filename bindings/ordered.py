"""Episodes, rates, trends, progress and batches over the event stream."""

from pyspark.sql import functions as F

from bindings.registry import FRAMES, frame, query, table
from opslens.operators import timeline
from opslens.plans.ordered import micros

GAP = 1800
MICRO = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _micro(df, *names):
    for name in names:
        df = df.withColumn(name, F.date_format(name, MICRO))
    return df


def _at(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or column}"


FRAMES["counter_sessions"] = """
SELECT concat('db', CAST(user_id % 4 AS STRING)) AS server, date_trunc('hour', ts) + INTERVAL '30' MINUTE AS snapshot_ts, user_id AS usr FROM {events}
"""

_EPISODES = f"""f AS (SELECT event_type, user_id % 3 AS grp, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {GAP * 1000000} THEN 0 ELSE 1 END AS opened
        FROM events WINDOW w AS (PARTITION BY event_type, user_id % 3 ORDER BY ts)),
    n AS (SELECT *, sum(opened) OVER (PARTITION BY event_type, grp ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM f),
    e AS (SELECT event_type, grp, min(ts) AS lo, max(ts) AS hi, count(*) AS samples, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS duration_s FROM n GROUP BY event_type, grp, no)"""


def _episodes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 3)
    return timeline.lock_episodes(rows, ["event_type", "grp"], "ts", GAP)


@query("lock_episodes", f"WITH {_EPISODES} SELECT event_type, grp, {_at('lo', 'episode_start')}, {_at('hi', 'episode_end')}, samples, duration_s FROM e")
def lock_episodes(spark, sf_dir):
    return _micro(_episodes(spark, sf_dir), "episode_start", "episode_end")


@query(
    "lock_episode_summary",
    f"""WITH {_EPISODES} SELECT event_type, grp, count(*) AS episodes, round(sum(duration_s), 3) AS total_s, max(duration_s) AS max_s, CAST(sum(samples) AS BIGINT) AS samples,
        CASE WHEN max(duration_s) >= 60 THEN 'HIGH' WHEN max(duration_s) >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM e GROUP BY event_type, grp""",
)
def lock_episode_summary(spark, sf_dir):
    out = timeline.episode_summary(_episodes(spark, sf_dir), ["event_type", "grp"])
    return out.withColumn("total_s", F.round("total_s", 3))


@query(
    "lock_episodes_top",
    f"""WITH {_EPISODES} SELECT event_type, grp, {_at('lo', 'episode_start')}, duration_s, row_number() OVER w AS rank FROM e
        WINDOW w AS (PARTITION BY event_type, grp ORDER BY duration_s DESC, lo) QUALIFY row_number() OVER w <= 5""",
)
def lock_episodes_top(spark, sf_dir):
    top = timeline.top_episodes(_episodes(spark, sf_dir), ["event_type", "grp"])
    return _micro(top, "episode_start").select("event_type", "grp", "episode_start", "duration_s", F.col("rank").cast("long").alias("rank"))


_RATES = """r AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value FROM {counters} WINDOW w AS (PARTITION BY server, name ORDER BY ts)),
    q AS (SELECT *, CASE WHEN value >= prev_value AND ts > prev_ts THEN round((value - prev_value) / ((epoch_us(ts) - epoch_us(prev_ts)) / 1000000.0::DOUBLE), 2) END AS rate FROM r)"""


@query("counter_rate", f"WITH {_RATES} SELECT server, name, {_at('ts')}, value, prev_value, rate FROM q")
def counter_rate(spark, sf_dir):
    out = timeline.counter_rate(frame(spark, sf_dir, "counters"))
    return _micro(out.select("server", "name", "ts", "value", "prev_value", "rate"), "ts")


@query(
    "counter_rate_alert",
    f"""WITH {_RATES}, a AS (SELECT server, ts AS alert_ts, rate FROM q WHERE rate > 350),
    s AS (SELECT DISTINCT server, snapshot_ts FROM {{counter_sessions}}),
    m AS (SELECT a.server, alert_ts, rate, snapshot_ts FROM a ASOF JOIN s ON a.server = s.server AND s.snapshot_ts >= a.alert_ts)
    SELECT server, {_at('alert_ts')}, rate, {_at('snapshot_ts')}, usr FROM m JOIN counter_sessions USING (server, snapshot_ts)""",
)
def counter_rate_alert(spark, sf_dir):
    rates = timeline.counter_rate(frame(spark, sf_dir, "counters"))
    shown = {f"shown_{c}": F.date_format(c, MICRO) for c in ("alert_ts", "snapshot_ts")}
    out = timeline.rate_alert(rates, frame(spark, sf_dir, "counter_sessions"), shown=shown)
    return out.select("server", F.col("shown_alert_ts").alias("alert_ts"), "rate", F.col("shown_snapshot_ts").alias("snapshot_ts"), "usr")


@query(
    "counter_alert_sessions",
    f"""WITH {_RATES}, a AS (SELECT server, ts AS alert_ts, rate FROM q WHERE rate > 350),
    s AS (SELECT DISTINCT server, snapshot_ts FROM {{counter_sessions}}),
    m AS (SELECT a.server, snapshot_ts, count(*) AS alerts, min(alert_ts) AS first_alert_ts, max(rate) AS max_rate
          FROM a ASOF JOIN s ON a.server = s.server AND s.snapshot_ts >= a.alert_ts GROUP BY ALL)
    SELECT server, {_at('snapshot_ts')}, usr, alerts, {_at('first_alert_ts')}, max_rate FROM m JOIN counter_sessions USING (server, snapshot_ts)""",
)
def counter_alert_sessions(spark, sf_dir):
    shots = frame(spark, sf_dir, "counter_sessions")
    alerts = timeline.alert_snapshots(timeline.counter_rate(frame(spark, sf_dir, "counters")), shots)
    out = timeline.captured_sessions(alerts, shots)
    return _micro(out, "snapshot_ts", "first_alert_ts").select("server", "snapshot_ts", "usr", "alerts", "first_alert_ts", "max_rate")


FRAMES["gauges"] = """
SELECT concat('db', CAST(user_id % 4 AS STRING)) AS server, ts, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS lag_s,
       CAST(floor(value * 4000) AS BIGINT) AS hll
FROM {events}
"""
_GAUGE = "g AS (SELECT *, lag(lag_s) OVER w AS p, lag(hll) OVER w AS ph FROM {gauges} WINDOW w AS (PARTITION BY server ORDER BY ts))"


@query(
    "replication_lag_trend",
    f"""WITH {_GAUGE} SELECT server, {_at('ts')}, lag_s, lag_s - p AS change, CASE WHEN lag_s > p THEN 'INCREASED' WHEN lag_s < p THEN 'DECREASED' WHEN lag_s = p THEN 'UNCHANGED' END AS trend,
        CASE WHEN lag_s = 0 THEN 'SYNCED' ELSE 'NOT SYNCED' END AS state FROM g""",
)
def replication_lag_trend(spark, sf_dir):
    return _micro(timeline.lag_trend(frame(spark, sf_dir, "gauges")), "ts")


@query(
    "history_length_trend",
    f"""WITH {_GAUGE} SELECT server, {_at('ts')}, hll, hll - ph AS delta, CASE WHEN hll >= 500000 THEN 'red' WHEN hll >= 100000 THEN 'yellow' ELSE 'green' END AS band FROM g""",
)
def history_length_trend(spark, sf_dir):
    return _micro(timeline.hll_trend(frame(spark, sf_dir, "gauges")), "ts")


FRAMES["progress"] = "SELECT event_type AS name, ts, event_id * 93 AS current, 50000000 AS target FROM {events}"
PROGRESS_SQL = f"""
    WITH p AS (SELECT name, ts, current, target, current * 1000000 // nullif(target, 0) AS ppm FROM {{progress}}),
    r AS (SELECT *, lag(ppm) OVER w AS p1, lag(ppm, 121) OVER w AS pn FROM p WHERE ppm > 0 WINDOW w AS (PARTITION BY name ORDER BY ts)),
    m AS (SELECT *, (1000000 - ppm) * 10000 // nullif(((p1 - pn) * 10000 // 120) * 2, 0) AS left_min FROM r)
    SELECT name, {_at('ts')}, current, target, ppm, ppm - p1 AS step_ppm, left_min AS minutes_left,
        CASE WHEN left_min IS NULL THEN 'estimating...' ELSE printf('%dd%02dh%02dm', left_min // 1440, left_min % 1440 // 60, left_min % 60) END AS eta FROM m
"""


# Samples without a target, beside those that have not begun.
FRAMES["progress_gaps"] = FRAMES["progress"].replace("50000000 AS target", "CASE WHEN event_id % 97 = 0 THEN 0 ELSE 50000000 END AS target")
IDLE = "FROM p WHERE coalesce(ppm, 0) <= 0"


@query(
    "progress_eta",
    PROGRESS_SQL.replace("{progress}", "{progress_gaps}") + f" UNION ALL SELECT name, {_at('ts')}, current, target, ppm, NULL, NULL, 'estimating...' {IDLE}",
)
def progress_eta(spark, sf_dir):
    out = timeline.progress_eta(frame(spark, sf_dir, "progress_gaps"))
    return _micro(out, "ts").withColumn("target", F.col("target").cast("int"))


@query("batch_numbers", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 2000 AS BIGINT) AS batch_id FROM orders")
def batch_numbers(spark, sf_dir):
    return timeline.batch_id(table(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", "batch_id")


@query(
    "batch_numbers_by_time",
    "SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS BIGINT) AS batch_id FROM events",
)
def batch_numbers_by_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return timeline.batch_id(rows, ["ts", "event_id"], 500, micros(F.col("ts"))).select("event_id", "batch_id")


@query(
    "statement_time_series_events",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS total, count(*) FILTER (event_type = 'signup') AS "insert", count(*) FILTER (event_type = 'click') AS "update",
        count(*) FILTER (event_type = 'purchase') AS "delete", count(*) FILTER (event_type = 'view') AS "select", 0::BIGINT AS "replace", count(*) FILTER (event_type = 'error') AS other FROM events GROUP BY 1""",
)
def statement_time_series_events(spark, sf_dir):
    return timeline.op_time_series(_verbs(spark, sf_dir), "day")


def _verbs(spark, sf_dir):
    verb = F.col("event_type")
    named = F.when(verb == "signup", "INSERT").when(verb == "click", "UPDATE").when(verb == "purchase", "DELETE").when(verb == "view", "SELECT")
    return table(spark, sf_dir, "events").withColumn("op", F.coalesce(named, F.lit("OTHER")))
