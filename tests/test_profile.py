import decimal
import random

from pyspark.sql import functions as F

from opslens.operators import profile, storage
from opslens.operators.profile import KeyInfo
from opslens.sources.catalog import catalog_from_df


def test_exact_profile_uses_key_shortcuts(spark):
    rows = spark.range(100).select(
        "id", F.when(F.col("id") < 95, F.col("id")).alias("external_id"),
        F.when(F.col("id") < 80, (F.col("id") % 40).cast("string")).otherwise("").alias("name"),
    )
    keys = {"id": KeyInfo("PRIMARY_SINGLE", False, "PRIMARY"), "external_id": KeyInfo("UNIQUE_SINGLE", True, "uq")}
    got = {r["column_name"]: r for r in profile.cardinality_profile(rows, keys, "exact").collect()}
    shown = {c: (r["eligible"], r["cardinality"], r["ratio"], r["selectivity_pct"], r["source"]) for c, r in got.items()}
    assert shown == {
        "id": (100, 100, 1.0, 100.0, "exact_key_shortcut"),
        "external_id": (95, 95, 1.0, 100.0, "exact_unique_nullable"),
        "name": (80, 40, 0.5, 50.0, "exact"),
    }


def test_metadata_profile_and_mode(spark):
    rows = spark.range(1).select("id", F.lit("x").alias("t"))
    keys = {"id": KeyInfo("PRIMARY_SINGLE", False, "PRIMARY", 900)}
    got = profile.cardinality_profile(rows, keys, "metadata", estimate=1_000_000).orderBy("ordinal").collect()
    assert [(r["cardinality"], r["source"], r["status"]) for r in got] == [(900, "metadata", "OK"), (None, "UNAVAILABLE", "WARNING")]
    assert profile.cardinality_profile(rows).filter("status = 'OK'").count() == 2


def test_stored_sketches_add_up_to_those_of_the_whole(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 7).alias("part"), (F.col("id") * 17 % 20_000).alias("n"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("").alias("t"),
        (F.col("id") % 11 / 2).alias("d"), F.create_map("id", "id").alias("m"),
    )
    names = ["n", "t", "d", "m"]
    shown = lambda df: [tuple(r)[1:] for r in profile.profile_from_sketches(df).orderBy("ordinal").collect()]
    stored = profile.profile_sketches(rows, [F.col("part")], names)
    assert stored.count() == 28
    parts, whole = shown(stored), shown(profile.profile_sketches(rows, columns=names))
    assert parts == whole
    by_name = {r[0]: r for r in parts}
    assert by_name["d"][2:4] == (30_000, 11) and by_name["t"][2] == 20_000
    assert abs(by_name["n"][3] / 20_000 - 1) < 0.05 and by_name["m"][2:4] == (None, None) and by_name["m"][6] == "ERROR"


def test_columns_that_cannot_be_compared_are_errors(spark):
    rows = spark.range(3).select("id", F.create_map("id", "id").alias("m"), F.array(F.struct(F.create_map("id", "id"))).alias("a"))
    got = profile.order_profile(profile.cardinality_profile(rows)).collect()
    assert [(r["column_name"], r["eligible"], r["status"]) for r in got] == [("id", 3, "OK"), ("m", None, "ERROR"), ("a", None, "ERROR")]


def test_drift_flag(spark):
    got = spark.createDataFrame([(None,), (10.0,), (10.01,)], "d double").select(profile.drift_flag(F.col("d"))).collect()
    assert [r[0] for r in got] == [None, "OK", "WARNING"]


def test_collation_aware_distinct(spark):
    rows = spark.createDataFrame([("A",), ("a",), ("b",)], "t string")
    count = lambda **kw: profile.cardinality_profile(rows, mode="exact", **kw).first()["cardinality"]
    assert count() == 3 and count(collation="UTF8_LCASE") == 2


def test_order_profile(spark):
    data = [
        (1, "card_tie_low", 100, 50, 50.0, "OK"), (2, "selectivity_tie_low", 20, 20, 100.0, "OK"),
        (3, "card_tie_high", 50, 50, 100.0, "OK"), (4, "zero_metric", 100, 0, 0.0, "OK"),
        (5, "not_available", None, None, None, "OK"), (6, "stable_tie", 100, 50, 50.0, "OK"), (7, "broken", 1, 9, 9.0, "ERROR"),
    ]
    rows = spark.createDataFrame(data, "ordinal int, column_name string, eligible long, cardinality long, selectivity_pct double, status string")
    names = lambda by: [r["column_name"] for r in profile.order_profile(rows, by).collect()]
    tail = ["zero_metric", "not_available", "broken"]
    assert names("cardinality") == ["card_tie_high", "card_tie_low", "stable_tie", "selectivity_tie_low", *tail]
    assert names("selectivity") == ["card_tie_high", "selectivity_tie_low", "card_tie_low", "stable_tie", *tail]


def test_row_drift(spark):
    row = spark.createDataFrame([(100, 50, 0, 7)], "e long, s long, z long, o long").select(
        profile.row_drift(F.col("e"), F.col("s")).alias("a"), profile.row_drift(F.col("z"), F.col("o")).alias("b"),
        profile.row_drift(F.col("z"), F.col("o"), "hundred").alias("c"),
    ).first()
    assert tuple(row) == (50.0, 0.0, 100.0)


def test_prefix_recommendation(spark):
    def advise(values):
        rows = [("c", i, v) for i, v in enumerate(values, 1)]
        return profile.recommend_prefix(spark.createDataFrame(rows, "column_name string, prefix_length int, selectivity double")).first()

    assert advise([0.5, 0.9, 1.0])["recommendation"] == "full column"
    assert advise([0.50, 0.97, 0.975, 0.98])["recommendation"] == "c(3)"


def test_prefix_selectivity_counts_frequent_values_fully(spark):
    rows = spark.createDataFrame([("aa",)] * 6 + [("ab",), ("b",), ("",), (None,)], "v string")
    got = [(r["prefix_length"], r["distinct_prefixes"], r["rows"], r["selectivity"]) for r in profile.prefix_selectivity(rows).orderBy("prefix_length").collect()]
    assert got == [(1, 2, 8, 0.25), (2, 3, 8, 0.375)]


def test_prefix_selectivity_equals_counting_prefixes(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("aä𝄞b") for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["x" * 80, "x" * 60, "x" * 60 + "y", None]
    got = {r["prefix_length"]: (r["distinct_prefixes"], r["rows"]) for r in profile.prefix_selectivity(spark.createDataFrame([(v,) for v in values], "v string"), max_prefix=70).collect()}
    kept = [v for v in values if v]
    assert got == {p: (len({v[:p] for v in kept}), len(kept)) for p in range(1, 71)}


def test_storage_projection(spark):
    columns = catalog_from_df(spark.range(1), "d", "t").select("*").limit(0)
    data = [("s", "d", "t", "id", 1, "bigint", "bigint", "NO", None, 19, None, None), ("s", "d", "t", "note", 2, "varchar(25)", "varchar", "YES", 100, None, "utf8mb4", "x")]
    rows = spark.createDataFrame(data, columns.schema)
    got = {r["table_name"]: r for r in storage.storage_projection(rows, 1000).collect()}
    assert set(got) == {"t", "TOTAL"}
    assert (got["t"]["data_mb_day"], got["t"]["idx_mb_day"], got["t"]["total_mb_day"]) == (0.1236, 0.0371, 0.1607)
    assert got["TOTAL"]["total_mb_day"] == 0.1607 and got["TOTAL"]["total_rows"] == decimal.Decimal(30000)


def test_total_row_is_not_a_table_without_name(spark):
    columns = catalog_from_df(spark.range(1), "d", "t").withColumn("table_name", F.lit(None).cast("string"))
    got = storage.storage_projection(columns, 10).orderBy("is_total").collect()
    assert [(r["table_name"], r["is_total"]) for r in got] == [(None, False), ("TOTAL", True)]


def test_key_info_deals_statistics_by_table_once(spark):
    """Two windows over one distribution, sorted by a hash first, and no aggregation; equal to a plain reading of the rules."""
    columns = spark.createDataFrame(
        [("s", "d", "t", c, "int", "NO") for c in "abce"] + [("s", "d", "u", "a", "int", "NO"), (None, "d", "t", "a", "int", "NO")],
        "server string, table_schema string, table_name string, column_name string, column_type string, is_nullable string",
    )
    statistics = spark.createDataFrame(
        [
            ("s", "d", "t", "PRIMARY", 0, 1, "a", 10), ("s", "d", "t", "k", 1, 1, "a", 8), ("s", "d", "t", "k", 1, 2, "b", 9),
            ("s", "d", "t", "u", 0, 1, "b", 7), ("s", "d", "t", "w", 1, 1, "c", 6), ("s", "d", "t", "w", 1, 2, "a", 6), (None, "d", "t", "w", 1, 1, "a", 5),
        ],
        "server string, table_schema string, table_name string, index_name string, non_unique int, seq_in_index int, column_name string, cardinality long",
    )
    info = profile.column_key_info(columns, statistics)
    shown = info.columns[:4] == ["server", "table_schema", "table_name", "column_name"] and "__table" not in info.columns
    rows = {(r["server"], r["table_name"], r["column_name"]): (r["metadata_cardinality"], r["source_index"], r["key_kind"], r["index_columns"], r["indexes"]) for r in info.collect()}
    none = (None, None, "UNAVAILABLE", 0, "---")
    assert shown and rows == {
        ("s", "t", "a"): (10, "PRIMARY", "PRIMARY_SINGLE", 1, "PRIMARY(#1), k(#1), w(#2)"), ("s", "t", "b"): (7, "u", "UNIQUE_SINGLE", 1, "k(#2), u(#1)"),
        ("s", "t", "c"): (6, "w", "LEADING_COMPOSITE", 2, "w(#1)"), ("s", "t", "e"): none, ("s", "u", "a"): none, (None, "t", "a"): none,
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = profile.column_key_info(columns, statistics)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 3 and plan.count("Sort [__table") == plan.count("Sort [") == 4 and "Aggregate" not in plan
