import datetime
import os

import pytest
from pyspark.sql import functions as F

from opslens.operators import movement, reports
from opslens.plans.published import published
from opslens.sources.catalog import catalog_foreign_keys, catalog_primary_keys, table_list
from opslens.sources.rows import synth_t1


def test_upsert_last_write_wins_and_hot_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)] + [(9, "old", i) for i in range(500)] + [(9, "new", 999)], "k int, v string, o int")
    got = sorted(map(tuple, movement.upsert(target, updates, ["k"], ["o"]).collect()))
    assert got == [(1, "a"), (2, "y"), (3, "z"), (9, "new")]


def test_partition_plan_names_its_own_period(spark):
    months = [(r["name"], str(r["less_than"])) for r in movement.partition_plan(spark, "2023-11-10", 3, "month").collect()]
    assert months == [("p202311", "2023-12-01"), ("p202312", "2024-01-01"), ("p202401", "2024-02-01")]
    years = [r["name"] for r in movement.partition_plan(spark, "2023-05-01", 2, "year").collect()]
    assert years == ["p2023", "p2024"]


def test_partitioned_write_spreads_a_hot_period(spark, tmp_path):
    rows = spark.range(2000).select("id", F.lit("2024-01-05").cast("timestamp").alias("ts"))
    path = str(tmp_path / "out")
    # The small-data setting would merge the tasks again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    movement.write_partitioned(rows, path, "ts", files_per_partition=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len([f for f in os.listdir(path + "/part=p202401") if f.endswith(".parquet")]) > 1
    assert spark.read.parquet(path).count() == 2000
    movement.compact(spark.read.parquet(path), str(tmp_path / "small"), "part", 2)
    assert spark.read.parquet(str(tmp_path / "small")).count() == 2000


def test_ranges_split_the_remainder_first(spark):
    got = [(r["first_id"], r["last_id"]) for r in movement.split_range(spark.range(1, 11), "id", 0, 100, 3).orderBy("worker").collect()]
    assert got == [(1, 4), (5, 7), (8, 10)]
    assert synth_t1(spark, 10, 3).groupBy("worker").count().orderBy("worker").collect() == [(1, 4), (2, 3), (3, 3)]
    assert movement.delete_range(spark.range(10), "id", 3, 4).count() == 6


def test_snapshot_diff_counts_copies(spark):
    old, new = (spark.createDataFrame([(v,) for v in vs], "v string") for vs in (["a", "a", "b"], ["a", "c"]))
    assert sorted(map(tuple, movement.snapshot_diff(old, new).collect())) == [("a", "-", 1), ("b", "-", 1), ("c", "+", 1)]


def test_report_is_published_whole(spark, tmp_path):
    path = str(tmp_path / "report.tsv")
    reports.write_report(spark.createDataFrame([('say "hi"', 1)], "t string, n int").coalesce(1), path)
    reports.write_report(spark.createDataFrame([('say "yo"', 2)], "t string, n int").coalesce(1), path)
    assert os.listdir(tmp_path) == ["report.tsv"]
    part = next(f for f in os.listdir(path) if f.startswith("part-"))
    assert open(f"{path}/{part}").read() == '"t"\t"n"\n"say ""yo"""\t"2"\n'
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception):
        reports.write_report(bad, path)
    assert open(f"{path}/{part}").read().startswith('"t"')
    assert reports.report_format("x.csv") == "csv"


def test_published_report_is_whole_at_any_time(spark, tmp_path):
    root = str(tmp_path / "report.csv")
    reports.publish_report(spark.createDataFrame([("a", 1)], "t string, n int"), root)
    first = reports.report_folder(spark, root)
    with pytest.raises(Exception):
        reports.publish_report(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), root)
    assert reports.report_folder(spark, root) == first
    reports.publish_report(spark.createDataFrame([("b", 2)], "t string, n int"), root)
    assert [tuple(r) for r in spark.read.option("header", True).csv(reports.report_folder(spark, root)).collect()] == [("b", "2")]
    assert spark.read.option("header", True).csv(first).first()["t"] == "a"


def test_merge_rewrites_only_buckets_that_change(spark, tmp_path):
    root, ddl = str(tmp_path / "target"), "k long, v string, o long"
    rows = [(i, f"v{i}", 0) for i in range(200)]
    schema = spark.createDataFrame([], ddl).schema
    read = lambda: sorted(map(tuple, movement.read_target(spark, root, schema).collect()))
    assert read() == []
    assert len(movement.merge_into(spark, root, spark.createDataFrame(rows, ddl), ["k"], ["o"], 8)) == 8
    before = published(spark, root)
    updates = spark.createDataFrame([(3, "x", 1), (3, "y", 1), (3, "w", 0), (7, "v7", 0), (500, None, 2)], ddl)
    changed = movement.merge_into(spark, root, updates, ["k"], ["o"], 8)
    after = published(spark, root)
    assert 1 <= len(changed) <= 2 and {n for n in before if before[n] != after[n]} == set(changed)
    expected = sorted({**{r[0]: r for r in rows}, 3: (3, "y", 1), 500: (500, None, 2)}.values())
    assert read() == expected
    assert movement.merge_into(spark, root, updates, ["k"], ["o"], 8) == [] and published(spark, root) == after and read() == expected


def test_archive_into_a_published_target(spark, tmp_path):
    root, ddl = str(tmp_path / "archive"), "id long, ts timestamp, v string"
    rows = spark.sql("SELECT id, timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) AS ts, 'v' AS v FROM range(100)")
    twice = rows.unionByName(rows.withColumn("v", F.lit("z")))
    for _ in range(2):
        movement.archive_into(spark, twice, root, "ts", "id", "2024-01-10", "2024-03-01", buckets=4)
    got = movement.read_target(spark, root, rows.schema)
    assert got.count() == 51 and {r["v"] for r in got.collect()} == {"z"}


def test_incident_reports_are_published_together(spark, tmp_path):
    ddl = "part int, type string, ts timestamp, user string, host string, thread string, trx string, op string, query string, template string"
    at = datetime.datetime(2024, 1, 1, 10)
    rows = spark.createDataFrame([(i % 2, "LOCK", at + datetime.timedelta(seconds=i), "u", "h", str(i), "x", "UPDATE", "q", "UPDATE t") for i in range(6)], ddl)
    root = str(tmp_path / "reports")
    reports.write_incident_reports(rows, root, per=["part"])
    read = lambda name: spark.read.option("header", True).csv(reports.report_folder(spark, root, name))
    assert set(published(spark, root)) == {"detail", "recap", "query_recap", "operations", "time_series", "contention", "recap_per_part"}
    assert read("detail").count() == 6 and read("recap").first()["occurrences"] == "6"
    assert sorted((r["part"], r["occurrences"]) for r in read("recap_per_part").collect()) == [("0", "3"), ("1", "3")]


def test_catalog_sources(spark, tmp_path):
    usage = spark.createDataFrame(
        [("s", "PRIMARY", "d", "t", "id", 1, None, None, None), ("s", "fk", "d", "t", "o_id", 1, "d", "o", "id")],
        "server string, constraint_name string, constraint_schema string, table_name string, column_name string, ordinal int, ref_schema string, ref_table string, ref_column string",
    )
    kinds = spark.createDataFrame([("s", "PRIMARY", "d", "t", "PRIMARY KEY"), ("s", "fk", "d", "t", "FOREIGN KEY")], "server string, constraint_name string, constraint_schema string, table_name string, constraint_type string")
    rules = spark.createDataFrame([("s", "fk", "d", "t", "CASCADE", "RESTRICT")], "server string, constraint_name string, constraint_schema string, table_name string, update_rule string, delete_rule string")
    assert [r["column_name"] for r in catalog_primary_keys(usage, kinds).collect()] == ["id"]
    assert [(r["column_name"], r["delete_rule"]) for r in catalog_foreign_keys(usage, rules).collect()] == [("o_id", "RESTRICT")]
    (tmp_path / "list.txt").write_text(" b \n# no\n\na\nb\n")
    assert [r["table_name"] for r in table_list(spark, str(tmp_path / "list.txt"), ["c", "a "]).collect()] == ["a", "b", "c"]


def test_incident_reports_find_participants_and_lock_seconds_once(spark, tmp_path, monkeypatch):
    """The recap of all groups takes its participants from those of every group and is the same as without them."""
    from opslens.operators import incidents

    ddl = "part int, type string, ts timestamp, user string, host string, thread string, trx string, op string, query string, template string"
    at = lambda i: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(seconds=i * i % 97)
    rows = spark.createDataFrame([(i % 3 or None, ("LOCK", "DEADLOCK")[i % 2], at(i), f"u{i % 4}", None if i % 5 else "h", str(i % 7), f"x{i}", "UPDATE", "q", f"UPDATE t{i % 2}") for i in range(40)], ddl)
    made = {"participants": 0, "lock_seconds": 0}

    def counted(name):
        plain = getattr(incidents, name)

        def run(*args, **kwargs):
            made[name] += 1
            return plain(*args, **kwargs)

        for module in (incidents, reports):
            monkeypatch.setattr(module, name, run)

    counted("participants"), counted("lock_seconds")
    found = reports.incident_reports(rows, per=["part"])
    assert made == {"participants": 1, "lock_seconds": 2}
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(found["recap"]) == plain(incidents.incidents(rows)) and plain(found["contention"]) == plain(incidents.contention_score(rows))
    assert plain(found["recap_per_part"]) == plain(incidents.incidents(rows, per=["part"])) and len(plain(found["recap"])) == 2


def test_columns_are_counted_without_rows_as_wide_as_the_table(spark):
    from bindings.stored import counted_by_column

    rows = spark.createDataFrame([("a", 1, 0.0), ("a", None, -0.0), (None, 1, float("nan")), ("1", 2, float("nan"))], "s string, i int, d double").withColumn("x", F.lit(None).cast("string"))
    out = counted_by_column(rows, rows.columns)
    assert sorted(map(tuple, out.collect())) == [("d", 4, 4, 2), ("i", 4, 3, 2), ("s", 4, 3, 2), ("x", 4, 0, 0)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, counted_by_column(rows.limit(0), ["s", "i"]).collect())) == [("i", 0, 0, 0), ("s", 0, 0, 0)]


def test_constraints_are_joined_by_a_hash_first(spark):
    """Servers and schemas are alike in their first bytes, by which a sort compares; null keys meet nothing, repeated ones each other."""
    usage = spark.createDataFrame(
        [("s", "PRIMARY", "d", "t", "id", 1, None), ("s", "PRIMARY", "d", "t", "id", 1, None), (None, "PRIMARY", "d", "t", "id", 1, None), ("s", "fk", "d", "t", "o_id", 1, "o")],
        "server string, constraint_name string, constraint_schema string, table_name string, column_name string, ordinal int, ref_table string",
    )
    kinds = usage.select("server", "constraint_schema", "table_name", "constraint_name", F.lit("PRIMARY KEY").alias("constraint_type")).filter("constraint_name = 'PRIMARY'")
    found = catalog_primary_keys(usage, kinds)
    assert [tuple(r) for r in found.collect()] == [("s", "d", "t", "id", 1)] * 4
    assert "hash(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_shared_frames_are_written_once(spark, tmp_path):
    import bindings.all  # noqa: F401
    from bindings import registry

    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    lines = [(1, 2, 3, 4, "N", "O"), (1, 2, 9, 4, "N", "O"), (1, 2, 3, 4, None, "O"), (1, 2, 3, 5, "A", "F"), (None, 2, 3, 5, "A", "F")]
    spark.createDataFrame(lines, kind).write.parquet(str(tmp_path / "lineitem.parquet"))
    named = registry.frame(spark, str(tmp_path), "line_tables")
    plain = spark.sql(registry._escaped(registry.FRAMES["line_tables"]), lineitem=registry.table(spark, str(tmp_path), "lineitem"))
    assert named.columns == plain.columns and sorted(map(str, named.collect())) == sorted(map(str, plain.collect()))
    for name, kind in (("customer", "c_custkey long"), ("part", "p_partkey long, p_size int"), ("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    made = registry.frames(spark, str(tmp_path), "cat_columns", "cat_stats", once=("line_tables",))
    for name, shared in zip(("cat_columns", "cat_stats"), made, strict=True):
        assert "Aggregate" not in shared._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, shared.collect())) == sorted(map(str, registry.frame(spark, str(tmp_path), name).collect())) != []


def test_stored_text_relations_are_compressed(spark, monkeypatch, tmp_path):
    import bindings.all  # noqa: F401
    from bindings import stored
    from bindings.registry import QUERIES

    spark.createDataFrame([(i, "O", "1-URGENT", i) for i in range(2000)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(stored, "scratch_dir", lambda spark, purpose: str(tmp_path / purpose))
    counted = {r["column_name"]: (r["rows"], r["filled"], r["different"]) for r in QUERIES["stored_locks"](spark, str(tmp_path)).collect()}
    assert counted["lock_id"] == (2000, 2000, 2000) and counted["lock_type"] == (2000, 2000, 1)
    files = list((tmp_path / "stored-locks").glob("part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files) and sum(f.stat().st_size for f in files) < 40_000
