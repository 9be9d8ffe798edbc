import gzip
import json

import pytest
from pyspark.sql import functions as F

from opslens.operators import binlog, engine_status, general_log, incidents
from opslens.sources import logs

HEAD = "2024-03-05T08:09:10.25Z  web[web]@[app-7.lan] 812 31 "


def _payloads(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string")


@pytest.mark.parametrize(
    "payload, expected",
    [
        (HEAD + "Query SELECT 2", ("web@app-7.lan", 812, "Query", "SELECT 2")),
        ("2024-03-05T08:09:10Z a[a] @ [::1]7 31\tQuery\tUPDATE t\nSET x = [1] @ [2]", ("a@::1", 7, "Query", "UPDATE t\nSET x = [1] @ [2]")),
        ("2024-12-31T23:59:59Z login[ svc ]  @[ h ] 5  31  Ping", ("svc@h", 5, "Ping", "")),
        (HEAD + "Reset\t Connection", ("web@app-7.lan", 812, "Reset Connection", "")),
        (HEAD + "Binlog Dump pos 4", ("web@app-7.lan", 812, "Binlog Dump", "pos 4")),
        (HEAD + "Table Dump shop items", ("web@app-7.lan", 812, "Table Dump", "shop items")),
        ("\n\t" + HEAD + "Statistics\n ", ("web@app-7.lan", 812, "Statistics", "")),
    ],
)
def test_accepted_payloads(spark, payload, expected):
    accepted, rejected = general_log.parse_general_log(_payloads(spark, [payload]), F.col("p"))
    row = accepted.first()
    assert (row["user_host"], int(row["thread_id"]), row["command_type"], row["argument"]) == expected
    assert rejected.count() == 0


@pytest.mark.parametrize(
    "payload, reason",
    [
        ("  \n", "empty payload"), (None, "empty payload"),
        (HEAD.replace("Z", "") + "Ping", "payload format mismatch"),
        (HEAD.replace(".25", ".") + "Ping", "payload format mismatch"), (HEAD.replace(".25", ".1234567") + "Ping", "payload format mismatch"),
        (HEAD.replace("@", "at") + "Ping", "payload format mismatch"), (HEAD.replace("web[web]", "[web]") + "Ping", "payload format mismatch"),
        (HEAD.replace("812", "-812") + "Ping", "payload format mismatch"), (HEAD.replace(" 31", "") + "Ping", "payload format mismatch"),
        (HEAD + "Pinging", "payload format mismatch"), (HEAD + "SELECT 1", "payload format mismatch"),
        (HEAD.replace("03-05", "02-30") + "Ping", "payload format mismatch"), (HEAD.replace("08:09", "24:61") + "Ping", "payload format mismatch"),
        ("a plain line \u0001 of text", "payload format mismatch"),
    ],
)
def test_rejected_payloads(spark, payload, reason):
    accepted, rejected = general_log.parse_general_log(_payloads(spark, [payload]), F.col("p"))
    assert accepted.count() == 0 and rejected.first()["reason"] == reason


def test_cloud_log_files(spark, tmp_path):
    entries = [{"textPayload": HEAD + "Quit"}, {"jsonPayload": {"message": 5, "query": HEAD + "Ping"}}, {"textPayload": 7}]
    (tmp_path / "a.json").write_text(json.dumps(entries))
    (tmp_path / "b.json").write_text("{not-json")
    (tmp_path / "c.json").write_text('{"textPayload": "x"}')
    accepted, rejected = general_log.parse_general_log(logs.cloud_log(spark, str(tmp_path), lines=False))
    assert sorted(r["command_type"] for r in accepted.collect()) == ["Ping", "Quit"]
    assert sorted((r["file"], r["reason"]) for r in rejected.collect()) == [
        ("a.json", "empty payload"), ("b.json", "invalid JSON"), ("c.json", "top-level JSON value is not a list")]
    lines = tmp_path / "lines.jsonl"
    lines.write_text("\n".join([*map(json.dumps, entries), "oops{"]))
    accepted, rejected = general_log.parse_general_log(logs.cloud_log(spark, str(lines)))
    assert (accepted.count(), rejected.count()) == (2, 2)


def _sample(stamp, dead=None, lock=True):
    wait = "mysql tables in use 1, locked 1\nLOCK WAIT 2 lock struct(s), heap size 1136, 1200 row lock(s)\n" if lock else ""
    part = f"LATEST DETECTED DEADLOCK\n---\n{dead} 0x7\n*** (1) TRANSACTION:\nTRANSACTION 77, ACTIVE 5 sec\nMySQL thread id 8, OS thread handle 1, query id 9 h1 u1 updating\nDELETE FROM d WHERE id=5\n" if dead else ""
    return (
        f"=====\n{stamp} 0x7f INNODB MONITOR OUTPUT\n=====\n{part}------------\nTRANSACTIONS\n------------\n---TRANSACTION 421, not started\n"
        f"---TRANSACTION 55, ACTIVE 12 sec\n{wait}MySQL thread id 9, OS thread handle 1, query id 5 h2 u2 updating\nUPDATE t SET a=1\n--------\nFILE I/O\n"
        "----------------------------\nEND OF INNODB MONITOR OUTPUT\n============================\n"
    )


def test_engine_status_files(spark, tmp_path):
    first = _sample("2024-01-01 10:00:00", "2024-01-01 07:29:00") + _sample("2024-01-01 10:00:05", "2024-01-01 07:31:00")
    (tmp_path / "20240101_10.sample").write_text(first + _sample("2024-01-01 10:00:20", "2024-01-01 07:31:00"))
    (tmp_path / "20240101_12.sample").write_text(_sample("2024-01-01 12:00:00"))
    (tmp_path / "notes.txt").write_text(_sample("2024-01-01 10:30:00"))

    def read(start=None, end=None):
        low, high = logs.sample_range(start, end)
        return engine_status.parse_engine_status(logs.innodb_samples(spark, str(tmp_path), start, end), start=low, end=high)

    rows = incidents.dedupe_incidents(read()).collect()
    assert sorted(r["type"] for r in rows) == ["DEADLOCK"] + ["LOCK"] * 4
    dead = next(r for r in rows if r["type"] == "DEADLOCK")
    assert (dead["user"], dead["host"], dead["thread"], dead["trx"], dead["template"]) == ("u1", "h1", "8", "77", "DELETE FROM d WHERE id = ? ")
    assert read(start="2024-01-01 12").count() == 1
    assert read(start="2024-01-01 10:30", end="2024-01-01 12").count() == 1
    assert logs.innodb_samples(spark, str(tmp_path), "2024-01-01 10:30", "2024-01-01 10:40").count() == 3
    assert logs.innodb_samples(spark, str(tmp_path), "2024-01-01 10:30", "2024-01-01 10:40", True).count() == 0
    score = incidents.contention_score(incidents.dedupe_incidents(read())).orderBy("template").collect()
    assert [(r["score"], r["deadlocks"]) for r in score] == [(30, 1), (20, 0)]
    trx = engine_status.status_transactions(logs.innodb_samples(spark, str(tmp_path), "2024-01-01 12")).collect()
    assert [(r["trx_id"], r["running"], r["rows_locked"], r["alert"], r["query"]) for r in trx] == [("55", "12 sec", 1200, "WARNING", "UPDATE t SET a=1")]


def test_times_that_do_not_exist_end_no_job(spark):
    rows = spark.createDataFrame([(_sample("2024-02-31 10:00:00", "2024-13-01 07:00:00"), "2024-01-01 10:00:00")], "text string, file_hour string")
    got = engine_status.parse_engine_status(rows).collect()
    assert [(r["type"], str(r["ts"])) for r in got] == [("LOCK", "2024-01-01 10:00:00")]
    assert engine_status.status_transactions(rows.drop("file_hour")).first()["sample_ts"] is None


def test_sample_range_widens_bounds():
    assert logs.sample_range("2024-01-01", None) == ("2024-01-01 00:00:00", "2024-01-01 23:59:59")
    assert logs.sample_range("2024-01-01 10", "2024-01-02 11:30") == ("2024-01-01 10:00:00", "2024-01-02 11:30:59")
    with pytest.raises(ValueError):
        logs.sample_range("2024-1-1", None)


TX = (
    "# at 4\n#240101 10:00:00 server id 1 end_log_pos 1 \tTable_map: `shop`.`a` mapped to number 7\n# at 90\n#240101 10:00:00 server id 1 \tWrite_rows: table id 7\n"
    "### INSERT INTO `shop`.`a`\n### SET\n### INSERT INTO `shop`.`a`\n# at 300\n#240101 10:00:00 server id 1 \tXid = 1\nCOMMIT/*!*/;\n"
)


def test_row_change_log_files(spark, tmp_path):
    with gzip.open(tmp_path / "bin.1.gz", "wt") as out:
        out.write(TX)
    (tmp_path / "bin.2").write_text("# start\n" + TX * 50 + "# at 999\n#end\n")
    records = logs.binlog_text(spark, str(tmp_path))
    per_file = binlog.binlog_transactions(records).filter("total > 0").groupBy("file").agg(F.count("*").alias("n"), F.sum("inserts").alias("i"))
    assert sorted(map(tuple, per_file.collect())) == [("bin.1.gz", 1, 2), ("bin.2", 50, 100)]
    by_tx = binlog.binlog_statements(binlog.binlog_events(records), ("file", "transaction_id"))
    by_event = binlog.binlog_statements(logs.binlog_events_text(spark, str(tmp_path)))
    assert by_tx.agg(F.sum("rows_affected")).first()[0] == by_event.agg(F.sum("rows_affected")).first()[0] == 102
    assert {r["table_name"] for r in by_tx.collect()} == {"`shop`.`a`"}
    announced = binlog.binlog_statements(binlog.binlog_events(records), ("file", "transaction_id"), "table_map")
    assert announced.count() == by_tx.count()


def test_changes_of_event_records_go_to_the_table_announced_last(spark):
    rows = [
        (9, "9\n### DELETE FROM `s`.`own`\n"),
        (10, "10\n#240101 10:00:00 server id 1 \tTable_map: `s`.`a` mapped to number 7"),
        (20, "20\n### INSERT INTO `s`.`a`\n###   @1=1\n### INSERT INTO `s`.`x`\n### DELETE FROM `s`.`a`"),
        (30, "30\n#240101 10:00:01 \tTable_map: `s`.`b` mapped to number 8"), (35, "35\nXid"),
        (40, "40\n### UPDATE `s`.`a`\n### UPDATE `s`.`a`"),
        (50, "50\n\tTable_map: `s`.`c` mapped to number 9\n### UPDATE `s`.`b`"),
    ]
    events = spark.createDataFrame([("f", *r) for r in rows], "file string, event_id long, text string")
    shown = lambda df: sorted((r["event_id"], r["table_name"][5:-1], r["op"], r["rows_affected"]) for r in df.collect())
    for points in ([], [25.0], [9.0, 10.0, 15.0, 36.0]):
        assert shown(binlog.binlog_statements(events, attribute="table_map", points=points)) == [
            (9, "own", "DELETE", 1), (20, "a", "DELETE", 1), (20, "a", "INSERT", 2), (40, "b", "UPDATE", 2), (50, "c", "UPDATE", 1)]
    assert shown(binlog.binlog_statements(events)) == [
        (9, "own", "DELETE", 1), (20, "a", "DELETE", 1), (20, "a", "INSERT", 1), (20, "x", "INSERT", 1), (40, "a", "UPDATE", 2), (50, "b", "UPDATE", 1)]


def test_transactions_of_event_records(spark):
    head = "\n#240101 10:00:0{} server id 1\n"
    rows = [
        ("f", 4, "4" + head.format(1) + "### INSERT INTO `a`\n### INSERT INTO `a`"), ("f", 20, "20\n### UPDATE `a`"), ("f", 30, "30\n\tXid = 1\nCOMMIT/*!*/;"),
        ("f", 40, "40" + head.format(5) + "### DELETE FROM `b`"), ("f", 50, "50\n### DELETE FROM `b`\nCOMMIT"), ("f", 60, "60\n### UPDATE `open`"),
        ("g", 10, "10\nCOMMIT"), ("g", None, "# header"),
    ]
    events = spark.createDataFrame(rows, "file string, event_id long, text string")
    for points in ([], [25.0, 35.0], [4.0, 20.0, 30.0, 40.0, 50.0, 55.0]):
        got = sorted((r["file"], r["transaction_id"], r["ts"] and r["ts"].second, r["inserts"], r["updates"], r["deletes"], r["total"]) for r in binlog.binlog_transactions_of_events(events, points=points).collect())
        assert got == [("f", 4, 1, 2, 1, 0, 3), ("f", 40, 5, 0, 0, 2, 2), ("f", 60, None, 0, 1, 0, 1), ("g", 10, None, 0, 0, 0, 0)]


def test_participant_lists_are_short(spark):
    rows = [("LOCK", f"2024-01-01 10:00:{i:02d}", f"u{i % 2}", "h", f"t{i}", f"x{i}", "q") for i in range(5)]
    df = spark.createDataFrame(rows, "type string, ts string, user string, host string, thread string, trx string, template string")
    row = incidents.incidents(df.withColumn("ts", F.col("ts").cast("timestamp"))).first()
    assert (row["users"], row["threads"], row["lock_seconds"]) == ("u0, u1", "t0, t1, t2 (+2 more)", 4)


def test_written_logs_are_small_and_read_back_whole(spark, tmp_path):
    from bindings.logs import _write_log
    from opslens.sources.logs import binlog_events_text

    def event(i):
        return f"# at {i}\n#240101 10:05:00 server id 1\n" + "### INSERT INTO `shop`.`item`\n### SET\n###   @1=5\n" * 20

    plain = sum(len(event(i)) for i in range(5000))
    _write_log(spark.range(5000).repartition(2).selectExpr("id").select(
        F.concat(F.lit("# at "), F.col("id").cast("string"), F.lit(event(0)[len("# at 0"):])).alias("text")
    ), str(tmp_path / "log"), "\nCOMMIT/*!*/;\n")
    written = sum(f.stat().st_size for f in (tmp_path / "log").glob("part-*"))
    assert written < plain / 20
    rows = binlog.binlog_statements(binlog_events_text(spark, str(tmp_path / "log")))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("rows_affected").alias("r"), F.count_distinct("event_id").alias("d")).first()
    assert (found["n"], found["r"], found["d"]) == (5000, 100_000, 5000)


def test_change_texts_are_taken_apart_once_for_the_ordered_passes(spark):
    text = "100\n#240101  9:05:07 server id 1\nTable_map: a mapped to number 1\n### INSERT INTO a\n### INSERT INTO a\n### UPDATE b\n"
    rows = spark.createDataFrame([("f", 100, text), ("f", 101, "101\n#240230 10:05:07\n### DELETE FROM a\nCOMMIT")], "file string, event_id long, text string")
    for out in (binlog.binlog_statements(rows, attribute="table_map", points=[100.5]), binlog.binlog_transactions_of_events(rows, points=[100.5])):
        assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = binlog.binlog_statements(rows).orderBy("event_id", "op").collect()
    assert [(r["event_id"], str(r["ts"]), r["op"], r["rows_affected"]) for r in got] == [
        (100, "2024-01-01 09:05:07", "INSERT", 2), (100, "2024-01-01 09:05:07", "UPDATE", 1), (101, "None", "DELETE", 1),
    ]


def test_event_records_are_searched_only_where_needed(spark, tmp_path, monkeypatch):
    from opslens.sources.logs import binlog_events_text

    log = (
        "# at 100\n#240101 10:05:07 server id 1\tTable_map: a mapped to number 7\n# at 120\n#240101 10:05:08 server id 1\n### INSERT INTO a\n"
        "# at 500\nXid = 1\nCOMMIT/*!*/;\n# at 600\n### UPDATE b\n### UPDATE b\n"
    )
    (tmp_path / "bin.1").write_text(log)
    written = []
    monkeypatch.setattr(binlog, "checkpointed", lambda df, purpose: written.append(df) or df)
    events = binlog_events_text(spark, str(tmp_path / "bin.1"))
    whole = binlog.binlog_transactions_of_events(events, points=[])
    listed = binlog.binlog_statements(events, attribute="table_map", points=[])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in written]
    # One search for a position, used in its test and its value, on the record's first line.
    assert all(plan.count("(?:# at )?") == 2 and plan.count("substring_index(value") == 2 for plan in plans)
    # One ordered pass, whose groups are counted without a sort.
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "SortAggregate" not in plan
    assert sorted((r["transaction_id"], r["ts"].second if r["ts"] else None, r["inserts"], r["updates"]) for r in whole.collect()) == [(100, 7, 1, 0), (600, None, 0, 2)]
    assert sorted((r["event_id"], r["table_name"], r["op"], r["rows_affected"]) for r in listed.collect()) == [(120, "a", "INSERT", 1), (600, "a", "UPDATE", 2)]


def test_ddl_is_found_in_any_case(spark):
    text = "#240101 10:05:07\nalter table a\n### Drop Table b\ncreate table\n x\nno ALTER TABLE c\n"
    got = binlog.binlog_ddl(spark.createDataFrame([(1, text), (2, "#240101 10:05:08\n"), (3, None)], "id int, text string")).orderBy("id").collect()
    assert [(r["alters"], r["creates"], r["drops"], r["total"]) for r in got] == [(1, 0, 1, 2), (0, 0, 0, 0), (None, None, None, None)]


def test_a_chronological_log_is_parsed_once(spark):
    """What reads the sorted entries reads them as written, not the payloads."""
    df = _payloads(spark, [HEAD + "Query SELECT 2", "2024-03-05T08:09:09Z a[a] @ [b] 7 31 Ping", "broken", None])
    accepted, rejected = general_log.parse_general_log(df, F.col("p"), chronological=True)
    assert [r["i"] for r in accepted.collect()] == [1, 0] and rejected.count() == 2
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and "Generate" not in plan and "Relation" in plan
    assert general_log.parse_general_log(df.limit(0), F.col("p"), chronological=True)[0].count() == 0
