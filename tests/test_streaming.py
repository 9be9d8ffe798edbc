import datetime

import pytest
from pyspark.sql import functions as F

from opslens.operators import sessions, timeline
from opslens.schemas import schema
from opslens.streaming import monitors

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Every state partition is a store of its own; small streams need few."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def _land(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


def test_session_delta_continues_over_batches(spark, tmp_path):
    src, out, state, ckpt = (str(tmp_path / n) for n in ("src", "out", "state", "ckpt"))
    ddl = "server string, snapshot_ts timestamp, user string"
    shots = [["a"] * 4, ["a"] * 6 + ["b"], ["b"] * 2, ["a"]]
    rows = [[("s", START + datetime.timedelta(minutes=i), u) for u in users] for i, users in enumerate(shots)]
    for shot in rows:
        _land(spark, src, shot, ddl)
        stream = monitors.stream_snapshots(spark, src, spark.createDataFrame([], ddl).schema)
        monitors.stream_session_delta(stream, ["user"], out, state, ckpt).awaitTermination()
    monitors.close_session_delta(spark, ["user"], out, state)
    got = {(r["snapshot_ts"], r["user"]): r["delta"] for r in spark.read.parquet(out).collect()}
    everything = spark.createDataFrame(sum(rows, []), ddl).groupBy("server", "snapshot_ts", "user").agg(F.count("*").alias("connections"))
    batch = {(r["snapshot_ts"], r["user"]): r["delta"] for r in sessions.session_delta(everything, ["user"]).collect()}
    assert got == batch
    assert sorted(got.values()) == [0, 1, 1, 1, 2]


def test_split_and_late_snapshots(spark, tmp_path):
    src, out, state, ckpt, late = (str(tmp_path / n) for n in ("src", "out", "state", "ckpt", "late"))
    ddl = "server string, snapshot_ts timestamp, user string"
    at = lambda i: START + datetime.timedelta(minutes=i)
    files = [[("s", at(0), "a")] * 2, [("s", at(0), "a"), ("s", at(0), "b"), ("s", at(1), "a")], [("s", at(1), "b")], [("s", at(2), "a"), ("s", at(0), "c")], [("s", at(1), "late"), ("t", at(0), "x")]]
    for rows in files:
        _land(spark, src, rows, ddl)
    stream = monitors.stream_snapshots(spark, src, spark.createDataFrame([], ddl).schema, max_files=1)
    monitors.stream_session_delta(stream, ["user"], out, state, ckpt, late=late).awaitTermination()
    monitors.close_session_delta(spark, ["user"], out, state)
    got = sorted((r["server"], r["snapshot_ts"].minute, r["user"], r["connections"], r["delta"]) for r in spark.read.parquet(out).collect())
    assert got == [("s", 0, "a", 3, 0), ("s", 0, "b", 1, 0), ("s", 1, "a", 1, -2), ("s", 1, "b", 1, 0), ("s", 2, "a", 1, 0), ("t", 0, "x", 1, 0)]
    assert sorted((r["snapshot_ts"].minute, r["user"]) for r in spark.read.parquet(late).collect()) == [(0, "c"), (1, "late")]


COUNTERS = "server string, name string, ts timestamp, value long"


def _at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_counter_rate_keeps_its_state(spark, tmp_path):
    """A sample is published by the run whose input moves the watermark past its slot."""
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    published = []
    for i, value in enumerate([10, 30, 5, 15]):
        _land(spark, src, [("s", "n", _at(10 * i), value)], COUNTERS)
        stream = monitors.stream_snapshots(spark, src, spark.read.parquet(src).schema)
        monitors.append_log(monitors.stream_counter_rate(stream, "0 seconds", slot_s=10), out, ckpt).awaitTermination()
        published.append(spark.read.schema("rate double").parquet(out).count())
    assert published == [0, 1, 2, 3]
    assert [r["rate"] for r in spark.read.parquet(out).orderBy("ts").collect()] == [None, 2.0, None]


def _mixed_files(spark, src, rows, ddl, order, far):
    """The rows in five files by time, written in another order, and a last one that closes all slots."""
    size = -(-len(rows) // 5)
    for i in order:
        _land(spark, src, rows[i * size : (i + 1) * size], ddl)
    _land(spark, src, [far], ddl)
    return monitors.stream_snapshots(spark, src, spark.createDataFrame([], ddl).schema, max_files=1)


def test_counter_rate_of_files_in_any_order_equals_the_batch_operator(spark, tmp_path):
    rows = [("s", n, _at(7 * i + (n == "b")), None if i % 13 == 5 else i * i % 97) for i in range(60) for n in ("a", "b")]
    stream = _mixed_files(spark, str(tmp_path / "src"), rows, COUNTERS, [2, 4, 0, 3, 1], ("s", "far", _at(10**6), 1))
    out = str(tmp_path / "out")
    monitors.append_log(monitors.stream_counter_rate(stream, "1 day", slot_s=30), out, str(tmp_path / "ckpt")).awaitTermination()
    key = lambda r: (r["name"], r["ts"])
    got = {key(r): (r["value"], r["rate"]) for r in spark.read.parquet(out).collect()}
    batch = timeline.counter_rate(spark.createDataFrame(rows, COUNTERS)).collect()
    assert got == {key(r): (r["value"], r["rate"]) for r in batch} and len(got) == 120


def test_progress_of_files_in_any_order_equals_the_batch_operator(spark, tmp_path):
    ddl = "name string, ts timestamp, current long, target long"
    rows = [("j", _at(30 * i), i * 11 if i % 7 else 0, 1000 if i % 9 else 0) for i in range(70)]
    stream = _mixed_files(spark, str(tmp_path / "src"), rows, ddl, [4, 1, 3, 0, 2], ("far", _at(10**6), 1, 1))
    out = str(tmp_path / "out")
    monitors.append_log(monitors.stream_progress_eta(stream, 5, watermark="1 day", slot_s=100), out, str(tmp_path / "ckpt")).awaitTermination()
    got = {r["ts"]: (r["ppm"], r["minutes_left"]) for r in spark.read.parquet(out).collect()}
    batch = timeline.progress_eta(spark.createDataFrame(rows, ddl), window=5).collect()
    assert got == {r["ts"]: (r["ppm"], r["minutes_left"]) for r in batch} and len(got) == 70


def test_idle_counters_are_forgotten_and_late_samples_dropped(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    for rows in ([("s", "n", _at(0), 1), ("s", "n", _at(10), 11)], [("s", "m", _at(5000), 0)], [("s", "n", _at(6000), 20), ("s", "n", _at(20), 12)], [("s", "m", _at(9000), 0)]):
        _land(spark, src, rows, COUNTERS)
    stream = monitors.stream_snapshots(spark, src, spark.createDataFrame([], COUNTERS).schema, max_files=1)
    monitors.append_log(monitors.stream_counter_rate(stream, "60 seconds", slot_s=10, idle_s=600), out, ckpt).awaitTermination()
    rows = spark.read.parquet(out).orderBy("name", "ts").collect()
    assert [(r["name"], r["ts"], r["rate"]) for r in rows] == [("m", _at(5000), None), ("n", _at(0), None), ("n", _at(10), 1.0), ("n", _at(6000), None)]


def test_a_monitor_stops_at_its_code_and_goes_on_from_its_checkpoint(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    ddl = "server string, ts timestamp, resize_code string, resize_progress string, pool_bytes string"
    for i, code in enumerate(["4", "5", "7", "5", "0", "5"]):
        _land(spark, src, [("s", _at(i), code, "50", "1024")], ddl)
    stream = lambda: monitors.stream_snapshots(spark, src, spark.createDataFrame([], ddl).schema, max_files=1)
    codes = lambda: [r["resize_code"] for r in spark.read.parquet(out).orderBy("ts").collect()]
    assert monitors.run_resize_monitor(stream(), out, ckpt) and codes() == ["4", "5", "7"]
    assert monitors.run_resize_monitor(stream(), out, ckpt) and codes() == ["4", "5", "7", "5", "0"]
    assert not monitors.run_resize_monitor(stream(), out, ckpt) and codes()[-1] == "5"


def test_delta_policies(spark):
    ddl = "server string, snapshot_ts timestamp, user string, connections long"
    at = lambda i: START + datetime.timedelta(minutes=i)
    rows = [("s", at(0), "a", 4), ("s", at(1), "a", 6), ("s", at(1), None, 3), ("s", at(2), None, 1), ("s", at(3), "a", 2)]
    df = spark.createDataFrame(rows, ddl)
    labels = lambda p: [r["delta_label"] for r in sessions.session_delta(df, ["user"], p).orderBy("snapshot_ts", F.desc("user")).collect()]
    assert labels("count") == ["+0", "+2", "+3", "-2", "+2"]
    assert labels("new") == ["-", "+2", "NEW", "-2", "NEW"]
    assert labels("zero") == ["0", "+2", "0", "-2", "0"]
    totals = sessions.session_delta_totals(sessions.session_delta(df, ["user"], "new")).orderBy("snapshot_ts").collect()
    assert [r["delta"] for r in totals] == [4, 5, -2, 2]


def test_schemas_parse():
    from opslens.schemas import DDL

    assert all(len(schema(name).fields) > 1 for name in DDL)
