"""Polling monitors as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryException
from pyspark.sql.types import StructType

from opslens.operators.general_log import general_log_activity
from opslens.operators.pool import resize_status
from opslens.operators.sessions import session_delta
from opslens.operators.timeline import op_time_series
from opslens.session import checkpointed

STALE = "9000 seconds"


def stream_snapshots(
    spark: SparkSession, path: str, schema: StructType, max_files: int = 100, fmt: str = "parquet",
    name: str | None = None,
) -> DataFrame:
    """Snapshot files as they arrive; ``max_files`` bounds one micro-batch, ``name`` selects files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.format(fmt).load(path)


def append_log(
    sdf: DataFrame, path: str, checkpoint: str, interval: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Append every result to a Parquet log; without ``interval`` process what is there and stop."""
    writer = sdf.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start(path)


INCIDENT_ID = ["type", "ts", "user", "host", "thread", "trx", "template"]


def dedupe_stream(sdf: DataFrame, columns: Sequence[str] = INCIDENT_ID, watermark: str = STALE, ts: str = "ts") -> DataFrame:
    """Repeated reports of one incident once, with state kept only for the staleness time."""
    return sdf.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(columns))


def stream_op_time_series(
    sdf: DataFrame, unit: str = "hour", watermark: str = STALE, dedupe: bool = False, ts: str = "ts", op: str = "op"
) -> DataFrame:
    """Statements per time bucket and verb; rows older than the watermark are stale."""
    marked = dedupe_stream(sdf, watermark=watermark, ts=ts) if dedupe else sdf.withWatermark(ts, watermark)
    return op_time_series(marked, unit, ts, op)


def stream_lock_episodes(
    sdf: DataFrame, keys: Sequence[str], gap_s: float = 15, watermark: str = STALE, ts: str = "ts"
) -> DataFrame:
    """Runs of lock samples per key as session windows.

    A session window ends one gap after its last event, and an event exactly at that end still
    belongs to it, as in the batch operator.
    """
    gap = f"{int(gap_s * 1_000_000)} microseconds"
    grouped = sdf.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    episodes = grouped.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count(F.lit(1)).alias("samples"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return episodes.select(
        *keys,
        F.col("lo").alias("episode_start"),
        F.col("hi").alias("episode_end"),
        "samples",
        ((us("hi") - us("lo")) / 1_000_000).alias("duration_s"),
    )


def _delta_step(counts: DataFrame, older: DataFrame, keys: Sequence[str], policy: str, lateness_s: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deltas of the snapshots that are now closed, state to keep, rows that came too late).

    A snapshot is closed once its server has one more than ``lateness_s`` newer; None closes all.  The state is
    the last published snapshot of each server and the open ones.
    """
    columns = ["server", "snapshot_ts", *keys]
    base = older.filter("closed").drop("closed")
    seen = base.groupBy("server").agg(F.max("snapshot_ts").alias("seen_ts"))
    arrived = counts.join(seen, "server", "left")
    in_time = F.col("seen_ts").isNull() | (F.col("snapshot_ts") > F.col("seen_ts"))
    late = arrived.filter(~in_time).drop("seen_ts")
    whole = arrived.filter(in_time).drop("seen_ts").unionByName(older.filter("not closed").drop("closed"))
    whole = whole.groupBy(*columns).agg(F.sum("connections").alias("connections"))
    newest = whole.groupBy("server").agg(F.max("snapshot_ts").alias("newest_ts"))
    age = F.unix_micros("newest_ts") - F.unix_micros("snapshot_ts")
    is_closed = F.lit(True) if lateness_s is None else age > int(lateness_s * 1_000_000)
    marked = whole.join(newest, "server").withColumn("closed", is_closed).drop("newest_ts")
    both = marked.filter("closed").drop("closed").unionByName(base)
    deltas = session_delta(both, keys, policy).join(seen, "server", "left").filter(in_time).drop("seen_ts")
    latest = both.groupBy("server").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    kept = both.join(latest, ["server", "snapshot_ts"]).withColumn("closed", F.lit(True))
    return deltas, kept.unionByName(marked.filter("not closed")), late


def stream_session_delta(
    sdf: DataFrame, keys: Sequence[str], out: str, state: str, checkpoint: str, policy: str = "count",
    interval: str | None = None, lateness_s: float = 0, late: str | None = None,
) -> StreamingQuery:
    """Session deltas of every whole snapshot against the one before it.

    The rows of a snapshot may come in several micro-batches: they are counted together, and the snapshot is
    published once a newer one of its server has come (more than ``lateness_s`` newer).  Published snapshots go
    through the batch operator with the last one before them.  Rows of a snapshot that is already published are
    written to ``late`` if that is given.  Results and state are written under the batch number, so a repeated
    batch overwrites its own output and nothing is kept in a task's memory.  When the input has ended,
    :func:`close_session_delta` publishes what is still open.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy("server", "snapshot_ts", *keys).agg(F.count(F.lit(1)).alias("connections"))
        none = counts.limit(0).withColumn("closed", F.lit(True))
        older = none if number == 0 else spark.read.schema(none.schema).parquet(f"{state}/batch={number - 1}")
        deltas, kept, missed = _delta_step(counts, older, keys, policy, lateness_s)
        deltas.write.mode("overwrite").parquet(f"{out}/batch={number}")
        kept.write.mode("overwrite").parquet(f"{state}/batch={number}")
        if late:
            missed.write.mode("overwrite").parquet(f"{late}/batch={number}")

    writer = sdf.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def close_session_delta(spark: SparkSession, keys: Sequence[str], out: str, state: str, policy: str = "count") -> None:
    """Publish the open snapshots of a stream that has ended; a second call publishes nothing new."""
    states = spark.read.parquet(state)
    last = states.agg(F.max("batch")).first()[0]
    if last is None:
        return
    older = states.filter(F.col("batch") == last).drop("batch")
    deltas, _, _ = _delta_step(older.drop("closed").limit(0), older, keys, policy, None)
    deltas.write.mode("overwrite").parquet(f"{out}/batch={last + 1}")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InTimeOrder(StatefulProcessor):
    """Hands a key's samples on in the order of their time, whatever the order they come in.

    Samples wait in slots of ``slot_s`` seconds, a state entry each, until the watermark has passed the slot; a timer
    at its end releases it.  So what is held at once is a slot of a key, not a key or a micro-batch.  Samples of a slot
    that the watermark has passed are dropped.  A key without samples for ``idle_s`` seconds is forgotten.
    """

    #: Columns of a sample beside its time, and the state that :meth:`follow` carries on, as DDL.
    sample = state = ""

    def __init__(self, slot_s: int, idle_s: int | None):
        self.slot_ms, self.idle_ms = slot_s * 1000, None if idle_s is None else idle_s * 1000

    def follow(self, key: tuple, rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """Results for ``rows`` in time order, and the state after them."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.split()[0] for f in self.sample.split(", ")]
        lists = ", ".join(f"{name} array<{kind}>" for name, kind in (f.split() for f in self.sample.split(", ")))
        self.waiting = handle.getMapState("waiting", "slot long", f"ts array<long>, {lists}")
        self.past = handle.getValueState("past", f"last_ms long, {self.state}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            us = some["ts"].to_numpy("datetime64[us]").astype("int64")
            slots = us // (1000 * self.slot_ms)
            due = timerValues.getCurrentWatermarkInMs()
            for slot in sorted(n for n in set(slots.tolist()) if (n + 1) * self.slot_ms > due):
                here = slots == slot
                new = [us[here].tolist(), *(_plain(some[name][here]) for name in self.names)]
                held = self.waiting.getValue((slot,)) if self.waiting.containsKey((slot,)) else [[]] * len(new)
                self.waiting.updateValue((slot,), tuple([*old, *more] for old, more in zip(held, new, strict=True)))
                self.handle.registerTimer((slot + 1) * self.slot_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for slot in sorted(s for (s,) in self.waiting.keys() if (s + 1) * self.slot_ms <= now):
            ts, *columns = self.waiting.getValue((slot,))
            self.waiting.removeKey((slot,))
            rows = pd.DataFrame({"ts": ts, **{name: pd.array(c, "Int64" if kind == "long" else "Float64") for (name, kind), c in zip((f.split() for f in self.sample.split(", ")), columns, strict=True)}})
            rows = rows.sort_values(["ts", *self.names], kind="stable", ignore_index=True)
            last_ms = int(rows["ts"].iloc[-1]) // 1000
            out, past = self.follow(key, rows, self.past.get()[1:] if self.past.exists() else None)
            self.past.update((last_ms, *past))
            if self.idle_ms is not None:
                self.handle.registerTimer(last_ms + self.idle_ms + 1)
            out.insert(len(key), "ts", pd.to_datetime(rows["ts"], unit="us"))
            yield out
        if self.idle_ms is not None and self.past.exists() and self.past.get()[0] + self.idle_ms < now:
            self.past.clear()

    def close(self) -> None:
        pass


def _plain(values: pd.Series) -> list:
    return [None if pd.isna(v) else v for v in values.tolist()]


def _in_time_order(sdf: DataFrame, keys: Sequence[str], processor: _InTimeOrder, out: str, watermark: str) -> DataFrame:
    """``processor`` over every key of ``sdf``; rows that come later than the watermark are dropped."""
    sdf.sparkSession.conf.set(*STATE_STORE)
    marked = sdf.filter(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    return marked.groupBy(*keys).transformWithStateInPandas(processor, StructType.fromDDL(out), "Append", "eventTime")


class _CounterRate(_InTimeOrder):
    sample, state = "value double", "ts long, value double"

    def follow(self, key: tuple, rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        ts, value = rows["ts"].to_numpy("float64"), rows["value"].to_numpy("float64", na_value=np.nan)
        before_ts, before = np.r_[np.nan, ts[:-1]], np.r_[np.nan, value[:-1]]
        if past is not None:
            before_ts[0], before[0] = past[0], np.nan if past[1] is None else past[1]
        elapsed = (ts - before_ts) / 1e6
        usable = (elapsed > 0) & (value >= before)
        rate = np.full(len(ts), np.nan)
        rate[usable] = (value[usable] - before[usable]) / elapsed[usable]
        out = pd.DataFrame({"server": [key[0]] * len(ts), "name": [key[1]] * len(ts), "value": value, "rate": np.round(rate, 2)})
        last = None if np.isnan(value[-1]) else float(value[-1])
        return out.astype({"value": "Float64", "rate": "Float64"}), (int(rows["ts"].iloc[-1]), last)


def stream_counter_rate(sdf: DataFrame, watermark: str = STALE, slot_s: int = 600, idle_s: int | None = None) -> DataFrame:
    """Change per second of ``(server, name)`` counters, in the order of their times; the state is one sample a counter.

    A sample is published when the watermark has passed its slot of ``slot_s`` seconds, after all that come before it.
    """
    narrow = sdf.select("server", "name", "ts", F.col("value").cast("double").alias("value"))
    out = "server string, name string, ts timestamp, value double, rate double"
    return _in_time_order(narrow, ["server", "name"], _CounterRate(slot_s, idle_s), out, watermark)


class _ProgressEta(_InTimeOrder):
    sample, state = "current long, target long", "positions array<long>"

    def __init__(self, slot_s: int, idle_s: int | None, window: int, period_s: int):
        super().__init__(slot_s, idle_s)
        self.window, self.period_s = window, period_s

    def follow(self, key: tuple, rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        ppm = (rows["current"] * 1_000_000) // rows["target"].mask(rows["target"] == 0)
        moving = np.flatnonzero((ppm > 0).fillna(False).to_numpy(bool))
        known = np.array([] if past is None else past[0], np.int64)
        path = np.r_[known, ppm.iloc[moving].to_numpy(np.int64)]
        # The window before each new position lies wholly among the positions so far, or gives no estimate yet.
        at = len(known) + np.arange(len(moving))
        whole = at > self.window
        left = np.full(len(moving), np.nan)
        mean = (path[at[whole] - 1] - path[at[whole] - 1 - self.window]) * 10_000 // self.window
        left[whole] = np.divide((1_000_000 - path[at[whole]]) * 10_000, mean * 60 / self.period_s, out=np.full(len(mean), np.nan), where=mean != 0)
        minutes = pd.Series(pd.NA, rows.index, "Int64")
        minutes.iloc[moving] = pd.array(np.floor(left), "Float64").astype("Int64")
        out = pd.DataFrame({"name": [key[0]] * len(rows), "ppm": ppm, "minutes_left": minutes})
        return out, (path[-(self.window + 1) :].tolist(),)


def stream_progress_eta(
    sdf: DataFrame, window: int = 120, period_s: int = 30, watermark: str = STALE, slot_s: int = 600, idle_s: int | None = None,
) -> DataFrame:
    """Time left from the mean of the last ``window`` steps, in the order of their times; the state is that many positions.

    As in :func:`stream_counter_rate` a sample is published when the watermark has passed its slot.
    """
    narrow = sdf.select("name", "ts", F.col("current").cast("long").alias("current"), F.col("target").cast("long").alias("target"))
    out = "name string, ts timestamp, ppm long, minutes_left long"
    return _in_time_order(narrow, ["name"], _ProgressEta(slot_s, idle_s, window, period_s), out, watermark)


def stream_log_activity(
    sdf: DataFrame, by: Sequence[str] = ("user_host", "command_type"), window: str = "1 hour", slide: str | None = None, watermark: str = STALE
) -> DataFrame:
    """General log entries per (sliding) window and key; a window is published when the watermark has passed its end."""
    return general_log_activity(sdf, by, window, slide, watermark)


class _Ended(Exception):
    """Raised in place of working on a batch after the one that ended the monitor."""


def run_until(sdf: DataFrame, stop: Column, out: str, checkpoint: str, interval: str | None = None) -> bool:
    """Append the rows of a stream below ``out`` until a batch has a row for which ``stop`` holds; whether one came.

    The batch with that row is the last one that is written and committed.  What came after it is left to the next run
    from the same checkpoint.  Without ``interval`` the run also ends with the input.  A batch is written under its
    number, so a repeated one overwrites its own rows.
    """
    ended: list[int] = []

    def handle(batch: DataFrame, number: int) -> None:
        if ended and number > ended[0]:
            raise _Ended
        rows = checkpointed(batch, "monitor")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if not rows.filter(stop).isEmpty():
            ended.append(number)

    writer = sdf.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    try:
        while not query.awaitTermination(1):
            if ended and not query.status["isTriggerActive"]:
                query.stop()
    except StreamingQueryException:
        if not ended:
            raise
    return bool(ended)


def run_resize_monitor(sdf: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> bool:
    """Stages of pool resizes until one is done (code 0) or has failed (code 7), as rows of ``resize_status``."""
    return run_until(resize_status(sdf), F.col("resize_code").cast("string").isin("0", "7"), out, checkpoint, interval)


def alerts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, once per broken rule; works on stored and streaming data."""
    fired = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    return df.withColumn("rule", F.explode(F.array_compact(fired)))
