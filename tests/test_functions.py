import datetime

import pytest
from pyspark.sql import functions as F

from opslens.functions import bands, hosts, statements, text, units
from opslens.operators import filters


@pytest.mark.parametrize(
    "host, expected",
    [
        ("10.0.0.5:41001", "10.0.0.5"), ("[2001:db8::1]:41003", "2001:db8::1"), ("[2001:db8::1]", "2001:db8::1"),
        ("2001:db8::1:41004", "2001:db8::1"), ("a.b.c.d.e:1", "a.b.c.d"), ("localhost", "localhost"), (None, None),
    ],
)
def test_host_normalize(one, host, expected):
    assert one(hosts.host_normalize, host) == expected


@pytest.mark.parametrize(
    "raw, template",
    [
        (
            "SELECT * FROM t WHERE a='x' AND b IN (1,2, -3.5) AND d>\"2024-01-01\"",
            "SELECT * FROM t WHERE a = ? AND b IN (?, ?, ?) AND d > ?",
        ),
        ("v 1 2 3 4 5 -6.5 7e-3 w", "v ? ? ? ? ? ? ? w"),
        ("x=_binary 'a\\'b' and y='it''s'", "x = ? and y = ??"),
        ("f(0xFF,TRUE, null) t1", "f (?, ?, ?) t1"),
        ("a\tb 'open", "ab 'open"),
    ],
)
def test_sql_template(one, raw, template):
    assert one(statements.sql_template, raw) == template


def test_template_of_long_text_with_many_escapes(one):
    raw = "a = '" + "x\\'" * 50_000 + "' b"
    assert one(statements.sql_template, raw) == "a = ? b"


def test_verbs(one):
    assert one(statements.sql_verb, "update t") == "UPDATE"
    assert one(statements.sql_verb, "with update") is None


def test_text_helpers(one, spark):
    assert one(text.sanitize_text, "SELECT\n*\tFROM t\\n\x00 x ") == "SELECT * FROM t x"
    assert one(lambda c: text.one_line(c, 5), "a\nb\r\tcdef") == "a b c"
    assert one(text.clean_error, "\x1b[31mbad\r\nthing") == "bad  thing"
    assert one(text.clean_error, "") == "unknown error"
    assert one(text.display_type, "enum('a','b')") == "ENUM"
    assert one(text.display_type, "varchar(10)") == "VARCHAR(10)"
    assert one(text.log_escape, "a\\b'c\"d\ne") == "a\\\\b''c\\\"d\\ne"
    assert one(lambda c: text.sql_literal(c, "varchar"), "it's") == "'it''s'"
    assert one(lambda c: text.sql_literal(c, "bigint"), "5") == "5"
    assert one(lambda c: text.sql_literal(c, "varchar"), "\\N") == "NULL"
    row = spark.sql("select array('a','b','c','d') x").select(text.first_n(F.col("x")).alias("r")).first()
    assert row["r"] == "a, b, c (+1 more)"


def test_units(one):
    assert one(units.human_bytes, 512, "long") == "512 B"
    assert one(units.human_bytes, 8589934592, "long") == "8.00 GiB"
    assert one(lambda c: units.ps_to_seconds(c), 1_234_567_890_123, "long") == 1.235
    assert one(lambda c: units.safe_ratio(c, F.lit(0), 4), 5, "long") is None
    assert one(lambda c: units.safe_ratio(c, F.lit(20000), 4), 1, "long") == 0.0001
    boot = F.lit(datetime.datetime(2024, 1, 1))
    assert one(lambda c: units.ps_to_timestamp(c, boot), 5 * 10**12, "long") == datetime.datetime(2024, 1, 1, 0, 0, 5)


def test_values_of_large_keys_are_rendered(spark, tmp_path):
    from bindings.movement import value_rendering

    keys = [(7, 3), (7_200_000, 360_000), (3_037_000_500, 4_000_000_000), (2**62, 2**40), (2**40, 0), (-(2**33), 5), (None, 1)]
    rows = [(1, p, s, 2, datetime.datetime(2024, 5, 6)) for p, s in keys if p is None or 0 < p < 2**62 and s]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "lineitem.parquet"))
    sizes = {r["l_partkey"]: r["size"] for r in value_rendering(spark, str(tmp_path)).collect()}
    assert sizes == {7: "147 B", 7_200_000: f"{7_200_000**2 * 360_000 / 2**40:.2f} TiB", 3_037_000_500: f"{3_037_000_500**2 * 4_000_000_000 / 2**40:.2f} TiB", None: None}
    whole = spark.createDataFrame(keys, "p long, s long").select(units.product(F.col("p"), F.col("p"), F.col("s")).alias("r")).collect()
    assert [r["r"] for r in whole] == [None if p is None else float(p * p * s) for p, s in keys]


def test_wide_numbers_stay_exact(spark):
    rows = spark.createDataFrame([("18446744073709551615",), ("9999999999999999999",)], "v string")
    ordered = rows.select(F.col("v").cast("decimal(20,0)").alias("v")).orderBy(F.desc("v")).collect()
    assert [str(r["v"]) for r in ordered] == ["18446744073709551615", "9999999999999999999"]


def test_bands(one):
    ages = [one(bands.age_band, a, "long") for a in (59, 60, 120, 300)]
    assert ages == ["none", "yellow", "orange", "red"]
    assert one(bands.query_band, 1000, "long") == "yellow"
    assert one(bands.resize_stage, "3") == "Withdrawing blocks"
    assert one(lambda c: bands.resize_progress(F.lit("3"), c), "150") == "100"
    assert one(lambda c: bands.resize_progress(F.lit(""), c), "5") == "N/A"
    assert one(bands.ping_ok, " null ") is True


def test_filters(spark):
    with pytest.raises(ValueError):
        filters.parse_list("a,,b", "user")
    with pytest.raises(Exception):
        filters.regex_list_filter(F.col("x"), "[")
    rows = spark.createDataFrame([("app%1",), ("app_x",), (None,)], "u string")
    hit = lambda cond: [r["u"] for r in rows.filter(cond).collect()]
    assert hit(filters.object_filter(F.col("u"), "%1")) == ["app%1"]
    assert hit(filters.wildcard_filter(F.col("u"), "none")) == [None]
    assert len(hit(filters.regex_list_filter(F.col("u"), ""))) == 3
    assert hit(filters.glob_filter(F.col("u"), "APP?x")) == ["app_x"]
