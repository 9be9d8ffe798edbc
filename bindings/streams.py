"""Streaming twins over the event table: run to the end of the input, then read the result log."""

from pyspark.sql import functions as F

from bindings.live import _COUNTS, _DELTA
from bindings.ordered import GAP, IDLE, PROGRESS_SQL, _EPISODES, _RATES, _at, _micro
from bindings.registry import query, table
from opslens.session import scratch_dir
from opslens.streaming import monitors


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    raw = monitors.stream_snapshots(spark, sf_dir, schema, name="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _in_files(spark, sf_dir, parts=5, closing=False, order=None):
    """The events as files in the order of their time, cut in the middle of an hour, read part by part.

    ``order`` writes the parts in another order.  ``closing`` adds a later event of no type, which moves the
    watermark past all others.
    """
    rows, path = table(spark, sf_dir, "events"), scratch_dir(spark, "event-files")
    bounds = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (bounds["hi"] - bounds["lo"]) / parts
    for i in order or range(parts):
        low, high = bounds["lo"] + i * step, bounds["lo"] + (i + 1) * step
        inside = (F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) if i < parts - 1 else F.lit(True))
        rows.filter(inside).write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    if closing:
        far = F.lit(bounds["hi"]) + F.expr("interval 300 days")
        one = spark.range(1).select(*[(far if c == "ts" else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        one.write.mode("append").parquet(path)
    raw = monitors.stream_snapshots(spark, path, rows.schema, max_files=-(-files // parts))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


# The parts are read in this order, so samples come up to a whole span late.
_MIXED = {"order": (3, 0, 4, 2, 1), "closing": True}
_SPAN = "120 days"


def _finished(sdf, name, mode="append"):
    """Write a stream to the shared folder until its input is used up, and read what it wrote."""
    spark = sdf.sparkSession
    out, state = scratch_dir(spark, f"{name}-log"), scratch_dir(spark, f"{name}-state")
    monitors.append_log(sdf, out, state, mode=mode).awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


@query(
    "stream_statement_time_series",
    f"""SELECT strftime(ts, '%Y-%m-%d %H:00') AS bucket, count(*) AS total, count(*) FILTER (event_type = 'signup') AS "insert", count(*) FILTER (event_type = 'click') AS "update",
        count(*) FILTER (event_type = 'purchase') AS "delete", count(*) FILTER (event_type = 'view') AS "select", 0::BIGINT AS "replace", count(*) FILTER (event_type = 'error') AS other
        FROM events GROUP BY 1""",
)
def stream_statement_time_series(spark, sf_dir):
    verb = F.col("event_type")
    named = F.when(verb == "signup", "INSERT").when(verb == "click", "UPDATE").when(verb == "purchase", "DELETE").when(verb == "view", "SELECT")
    rows = _in_files(spark, sf_dir, closing=True).withColumn("op", F.coalesce(named, F.lit("OTHER")))
    return _finished(monitors.stream_op_time_series(rows, "hour"), "series")


@query(
    "stream_lock_episodes",
    f"""WITH {_EPISODES} SELECT event_type, grp, {_at('lo', 'episode_start')}, {_at('hi', 'episode_end')}, samples, duration_s FROM e""",
)
def stream_lock_episodes(spark, sf_dir):
    rows = _in_files(spark, sf_dir, closing=True).withColumn("grp", F.col("user_id") % 3)
    episodes = monitors.stream_lock_episodes(rows, ["event_type", "grp"], GAP)
    return _micro(_finished(episodes, "episodes"), "episode_start", "episode_end")


@query("stream_counter_rate", f"WITH {_RATES} SELECT server, name, {_at('ts')}, CAST(value AS DOUBLE) AS value, rate FROM q")
def stream_counter_rate(spark, sf_dir):
    rows = _in_files(spark, sf_dir, **_MIXED).select(
        F.concat(F.lit("db"), (F.col("user_id") % 4).cast("string")).alias("server"),
        F.concat(F.lit("com_"), "event_type").alias("name"), "ts",
        F.when(F.col("event_id") % 97 == 0, 0).otherwise(F.col("event_id") * 1000 + F.floor("value")).alias("value"),
    )
    return _micro(_finished(monitors.stream_counter_rate(rows, _SPAN, 86_400), "rates"), "ts")


@query(
    "stream_progress_eta",
    PROGRESS_SQL.replace("SELECT name, strftime", "SELECT name, strftime", 1).replace(
        "current, target, ppm, ppm - p1 AS step_ppm, left_min AS minutes_left,", "ppm, left_min AS minutes_left, '' AS unused,"
    ).split(", '' AS unused,")[0] + f" FROM m UNION ALL SELECT name, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), ppm, NULL {IDLE}",
)
def stream_progress_eta(spark, sf_dir):
    rows = _in_files(spark, sf_dir, **_MIXED).select(
        F.col("event_type").alias("name"), "ts", (F.col("event_id") * 93).alias("current"), F.lit(50000000).alias("target")
    )
    return _micro(_finished(monitors.stream_progress_eta(rows, watermark=_SPAN, slot_s=86_400), "eta"), "ts")


@query(
    "stream_session_delta",
    f"""WITH {_COUNTS}, d AS (SELECT *, {_DELTA['count'][0]} AS delta FROM j)
        SELECT server, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS snapshot_ts, "user", db, connections, prev_value, delta, {_DELTA['count'][1]} AS delta_label FROM d""",
)
def stream_session_delta(spark, sf_dir):
    user = F.col("user_id") % 10
    rows = _in_files(spark, sf_dir).select(
        F.concat(F.lit("db"), (F.col("event_id") % 3).cast("string")).alias("server"), F.date_trunc("hour", "ts").alias("snapshot_ts"),
        F.when(user != 0, F.concat(F.lit("u"), user.cast("string"))).alias("user"), F.col("event_type").alias("db"),
    )
    out, state, checkpoint = (scratch_dir(spark, f"delta-{n}") for n in ("log", "state", "checkpoint"))
    monitors.stream_session_delta(rows, ["user", "db"], out, state, checkpoint).awaitTermination()
    monitors.close_session_delta(spark, ["user", "db"], out, state)
    result = spark.read.parquet(out).drop("batch")
    return result.withColumn("snapshot_ts", F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss"))


@query("stream_deduplicated", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events")
def stream_deduplicated(spark, sf_dir):
    rows = _stream(spark, sf_dir)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    unique = monitors.dedupe_stream(twice, ["user_id", "event_type", "ts"]).select("user_id", "event_type", "ts")
    return _micro(_finished(unique, "unique"), "ts")


@query(
    "stream_alerts",
    "SELECT event_id, 'slow' AS rule FROM events WHERE value > 100 UNION ALL SELECT event_id, 'failed' FROM events WHERE event_type = 'error'",
)
def stream_alerts(spark, sf_dir):
    rules = {"slow": F.col("value") > 100, "failed": F.col("event_type") == "error"}
    fired = monitors.alerts(_stream(spark, sf_dir), rules).select("event_id", "rule")
    return _finished(fired, "alerts")


@query(
    "stream_resize_until_failed",
    """SELECT event_id, CASE WHEN event_type = 'error' AND day(ts) BETWEEN 11 AND 15 THEN '7' ELSE '5' END AS resize_code,
        CASE WHEN event_type = 'error' AND day(ts) BETWEEN 11 AND 15 THEN 'Resize failed' ELSE 'Resizing pool' END AS stage FROM events WHERE day(ts) <= 15""",
)
def stream_resize_until_failed(spark, sf_dir):
    """Five days of samples land at a time; the resize fails in the third lot, and the two after it are never read."""
    path, out, checkpoint = (scratch_dir(spark, f"resize-{n}") for n in ("files", "log", "checkpoint"))
    day = F.dayofmonth("ts")
    code = F.when((F.col("event_type") == "error") & day.between(11, 15), "7").otherwise("5")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), code.alias("resize_code"), F.lit("10").alias("resize_progress"), F.lit("1024").alias("pool_bytes"),
    )
    for low in range(1, 32, 5):
        rows.filter(day.between(low, low + 4)).write.mode("append").parquet(path)
        if monitors.run_resize_monitor(monitors.stream_snapshots(spark, path, rows.schema), out, checkpoint):
            break
    return spark.read.parquet(out).select("event_id", "resize_code", "stage")


@query(
    "stream_log_activity",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS command_type, count(*) AS entries
        FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL""",
)
def stream_log_activity(spark, sf_dir):
    rows = _in_files(spark, sf_dir, closing=True).select(F.col("ts").alias("event_time"), F.col("event_type").alias("command_type"))
    out = _finished(monitors.stream_log_activity(rows, ["command_type"], "2 hours", "1 hour"), "activity")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
