"""Column profiles, key ranking, prefixes and storage projections."""

from pyspark.sql import functions as F

from opslens.session import checkpointed
from bindings.registry import frame, frames, query, table
from opslens.operators import profile, storage
from opslens.operators.profile import KeyInfo

ELIGIBLE_TEXT = "{c} IS NOT NULL AND octet_length(encode({c})) > 0"


def _profile_sql(name: str, columns: list[tuple[str, str, str]]) -> str:
    """Oracle: one aggregate per column; ``columns`` holds name, type and how it is counted."""
    parts = []
    for i, (column, kind, how) in enumerate(columns, start=1):
        if how == "key":
            eligible, distinct, source = "count(*)", "count(*)", "exact_key_shortcut"
        elif how == "unique":
            eligible, distinct, source = f"count({column})", f"count({column})", "exact_unique_nullable"
        else:
            test = ELIGIBLE_TEXT.format(c=column) if kind == "string" else f"{column} IS NOT NULL"
            eligible = f"count(CASE WHEN {test} THEN 1 END)"
            distinct = f"count(DISTINCT CASE WHEN {test} THEN {column} END)"
            source = "exact"
        parts.append(
            f"SELECT {i} AS ordinal, '{column}' AS column_name, '{kind}' AS column_type, {eligible} AS eligible, "
            f"{distinct} AS cardinality, '{source}' AS source, CAST({'NULL' if how == 'plain' else repr('idx')} AS VARCHAR) AS source_index, "
            f"'OK' AS status FROM {name}"
        )
    return (
        "WITH counts AS (" + " UNION ALL ".join(parts) + ") SELECT *, "
        "((cardinality * 20000 + eligible) // (2 * eligible)) / 10000.0::DOUBLE AS ratio, "
        "((cardinality * 20000 + eligible) // (2 * eligible)) / 100.0::DOUBLE AS selectivity_pct FROM counts"
    )


LAYOUTS = {
    "orders": [
        ("o_orderkey", "bigint", "key"), ("o_custkey", "bigint", "plain"), ("o_orderstatus", "string", "plain"),
        ("o_totalprice", "double", "plain"), ("o_orderdate", "timestamp_ntz", "plain"), ("o_orderpriority", "string", "plain"),
    ],
    "customer": [
        ("c_custkey", "bigint", "key"), ("c_name", "string", "unique"), ("c_nationkey", "int", "plain"),
        ("c_acctbal", "double", "plain"), ("c_mktsegment", "string", "plain"),
    ],
    "part": [
        ("p_partkey", "bigint", "key"), ("p_name", "string", "plain"), ("p_brand", "string", "plain"),
        ("p_type", "string", "plain"), ("p_size", "int", "plain"), ("p_retailprice", "double", "plain"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint", "plain"), ("l_partkey", "bigint", "plain"), ("l_suppkey", "bigint", "plain"),
        ("l_linenumber", "int", "plain"), ("l_quantity", "double", "plain"), ("l_extendedprice", "double", "plain"),
        ("l_discount", "double", "plain"), ("l_tax", "double", "plain"), ("l_returnflag", "string", "plain"),
        ("l_linestatus", "string", "plain"), ("l_shipdate", "timestamp_ntz", "plain"),
    ],
    "documents": [
        ("doc_id", "bigint", "key"), ("text", "string", "plain"), ("lang", "string", "plain"),
        ("source", "string", "plain"), ("n_chars", "bigint", "plain"),
    ],
}


def _keys(name: str) -> dict[str, KeyInfo]:
    kinds = {"key": ("PRIMARY_SINGLE", False), "unique": ("UNIQUE_SINGLE", True)}
    return {c: KeyInfo(*kinds[how], index="idx") for c, _, how in LAYOUTS[name] if how in kinds}


def _bind(name: str) -> None:
    @query(f"cardinality_profile_{name}", _profile_sql(name, LAYOUTS[name]))
    def run(spark, sf_dir):
        return profile.cardinality_profile(table(spark, sf_dir, name), _keys(name), mode="exact")


for _name in LAYOUTS:
    _bind(_name)


@query(
    "row_drift_per_customer",
    """
    SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS estimate, count(o_orderkey) AS exact,
           abs(count(o_orderkey) - c_nationkey) AS difference,
           CASE WHEN count(o_orderkey) = 0 THEN 0.0
                ELSE ((abs(count(o_orderkey) - c_nationkey) * 20000 + count(o_orderkey)) // (2 * count(o_orderkey))) / 100.0 END::DOUBLE AS drift_zero,
           CASE WHEN count(o_orderkey) = 0 THEN CASE WHEN c_nationkey = 0 THEN 0.0 ELSE 100.0 END
                ELSE ((abs(count(o_orderkey) - c_nationkey) * 20000 + count(o_orderkey)) // (2 * count(o_orderkey))) / 100.0 END::DOUBLE AS drift_pct
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey
    """,
)
def row_drift_per_customer(spark, sf_dir):
    from opslens.operators.topology import topology_cardinality

    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    tables = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select(
        "c_custkey", F.col("c_nationkey").cast("long").alias("estimate"), F.coalesce("n", F.lit(0)).alias("exact")
    )
    both = topology_cardinality(tables)
    return both.withColumn("drift_zero", profile.row_drift(F.col("exact"), F.col("estimate"), "zero"))


def _prefix_sql(name: str, column: str, max_prefix: int) -> str:
    return f"""
    SELECT '{column}' AS column_name, CAST(i AS INTEGER) AS prefix_length, count(DISTINCT left({column}, i)) AS distinct_prefixes,
           count(*) AS rows,
           ((count(DISTINCT left({column}, i)) * 20000 + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS selectivity
    FROM {name}, (SELECT unnest(range((SELECT greatest(1, min(length({column}))) FROM {name} WHERE {column} <> ''),
        (SELECT greatest(greatest(1, min(length({column}))), least(max(length({column})), {max_prefix})) FROM {name} WHERE {column} <> '') + 1)) AS i) lengths
    WHERE {column} IS NOT NULL AND {column} <> '' GROUP BY i"""


PREFIXED = (("customer", "c_name"), ("part", "p_name"), ("documents", "source"), ("pages", "url"))


@query(
    "profile_sketches_by_day",
    """
    WITH r AS (SELECT event_type, user_id % 90 AS slot, hour(ts) AS hour, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'k' || (user_id % 30) END AS text FROM events)
    SELECT 1 AS ordinal, 'event_type' AS column_name, count(event_type) AS eligible, count(DISTINCT event_type) AS cardinality, 'OK' AS status FROM r
    UNION ALL SELECT 2, 'slot', count(slot), count(DISTINCT slot), 'OK' FROM r
    UNION ALL SELECT 3, 'hour', count(hour), count(DISTINCT hour), 'OK' FROM r
    UNION ALL SELECT 4, 'text', count(*) FILTER (text <> ''), count(DISTINCT text) FILTER (text <> ''), 'OK' FROM r
    UNION ALL SELECT 5, 'tags', NULL, NULL, 'ERROR'
    """,
)
def profile_sketches_by_day(spark, sf_dir):
    """Sketches stored per day and added up: few distinct values, for which the estimates are exact."""
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.to_date("ts").alias("day"), "event_type", (F.col("user_id") % 90).alias("slot"), F.hour("ts").alias("hour"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("k"), (F.col("user_id") % 30).cast("string"))).alias("text"),
        F.create_map("event_type", "user_id").alias("tags"),
    )
    stored = checkpointed(profile.profile_sketches(rows, [F.col("day")], ["event_type", "slot", "hour", "text", "tags"]), "sketches")
    return profile.profile_from_sketches(stored).select("ordinal", "column_name", "eligible", "cardinality", "status")


@query("prefix_selectivity", " UNION ALL ".join(_prefix_sql(t, c, 50) for t, c in PREFIXED))
def prefix_selectivity(spark, sf_dir):
    parts = [profile.prefix_selectivity(table(spark, sf_dir, t), [c]) for t, c in PREFIXED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "prefix_recommendation",
    "WITH s AS (" + " UNION ALL ".join(_prefix_sql(t, c, 50) for t, c in PREFIXED) + """),
    d AS (SELECT column_name, prefix_length, CAST(round(selectivity * 10000) AS BIGINT) AS v FROM s),
    e AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY column_name ORDER BY prefix_length), 0) AS p,
                 last_value(v) OVER (PARTITION BY column_name ORDER BY prefix_length ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM d)
    SELECT column_name, min(CASE WHEN v * 100 >= best * 95 AND v - p <= 100 THEN prefix_length END) AS prefix_length,
           max(best) / 10000.0::DOUBLE AS full_selectivity,
           coalesce(column_name || '(' || CAST(min(CASE WHEN v * 100 >= best * 95 AND v - p <= 100 THEN prefix_length END) AS VARCHAR) || ')', 'full column') AS recommendation
    FROM e GROUP BY column_name""",
)
def prefix_recommendation(spark, sf_dir):
    return profile.recommend_prefix(prefix_selectivity(spark, sf_dir))


@query(
    "column_key_info",
    """
    WITH sizes AS (SELECT server, table_schema, table_name, index_name, count(*) AS index_columns FROM {cat_stats} GROUP BY ALL),
    ranked AS (
        SELECT s.*, z.index_columns, row_number() OVER (PARTITION BY s.server, s.table_schema, s.table_name, s.column_name ORDER BY
            CASE WHEN seq_in_index = 1 AND index_columns = 1 AND non_unique = 0 THEN 1 WHEN seq_in_index = 1 AND index_columns = 1 THEN 2
                 WHEN seq_in_index = 1 THEN 3 ELSE 4 END, CASE WHEN s.index_name = 'PRIMARY' THEN 0 ELSE 1 END, s.index_name) AS rn
        FROM cat_stats s JOIN sizes z USING (server, table_schema, table_name, index_name)),
    lists AS (SELECT server, table_schema, table_name, column_name,
        string_agg(index_name || '(#' || seq_in_index || ')', ', ' ORDER BY index_name, seq_in_index) AS indexes FROM cat_stats GROUP BY ALL)
    SELECT c.server, c.table_schema, c.table_name, c.column_name, c.column_type, c.is_nullable,
        CASE WHEN seq_in_index = 1 THEN cardinality END AS metadata_cardinality,
        CASE WHEN seq_in_index = 1 THEN index_name END AS source_index,
        CASE WHEN seq_in_index <> 1 OR seq_in_index IS NULL THEN 'UNAVAILABLE' WHEN index_columns = 1 AND index_name = 'PRIMARY' THEN 'PRIMARY_SINGLE'
             WHEN index_columns = 1 AND non_unique = 0 THEN 'UNIQUE_SINGLE' WHEN index_columns = 1 THEN 'LEADING_SINGLE' ELSE 'LEADING_COMPOSITE' END AS key_kind,
        coalesce(index_columns, 0) AS index_columns, coalesce(indexes, '---') AS indexes
    FROM {cat_columns} c LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (server, table_schema, table_name, column_name)
    LEFT JOIN lists USING (server, table_schema, table_name, column_name)
    """,
)
def column_key_info(spark, sf_dir):
    info = profile.column_key_info(*frames(spark, sf_dir, "cat_columns", "cat_stats", once=("line_tables",)))
    return info.select(
        "server", "table_schema", "table_name", "column_name", "column_type", "is_nullable",
        "metadata_cardinality", "source_index", "key_kind", "index_columns", "indexes",
    )


@query(
    "index_examiner",
    """
    SELECT s.server, s.table_schema, s.table_name, s.index_name, s.column_name,
           CASE WHEN non_unique = 0 THEN 'UNIQUE' ELSE 'NON_UNIQUE' END AS uniqueness, seq_in_index,
           string_agg(column_name, ', ') OVER (PARTITION BY server, table_schema, table_name, index_name ORDER BY seq_in_index
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS index_column_list
    FROM {cat_stats} s
    """,
)
def index_examiner(spark, sf_dir):
    return profile.index_examiner(frame(spark, sf_dir, "cat_stats"))


_WIDTH = """CASE WHEN data_type IN ('tinyint','bool','boolean') THEN 1 WHEN data_type = 'smallint' THEN 2 WHEN data_type = 'mediumint' THEN 3
    WHEN data_type = 'int' THEN 4 WHEN data_type = 'bigint' THEN 8 WHEN data_type = 'float' THEN 4 WHEN data_type = 'double' THEN 8
    WHEN data_type = 'decimal' THEN numeric_precision / 2.0 + 1 WHEN data_type = 'date' THEN 3 WHEN data_type IN ('datetime','timestamp') THEN 8
    WHEN data_type = 'time' THEN 3 WHEN data_type = 'year' THEN 1 WHEN data_type IN ('char','varchar','binary','varbinary') THEN char_octet_length
    WHEN data_type LIKE '%text%' OR data_type LIKE '%blob%' OR data_type IN ('json','geometry','point') THEN 1024 ELSE 8 END"""


@query(
    "storage_projection",
    f"""
    WITH t AS (SELECT server, table_schema, table_name, CAST(sum({_WIDTH}) AS DOUBLE) AS w FROM {{cat_columns}} GROUP BY ALL),
    r AS (SELECT *, 1 AS n, 'TABLE' AS level FROM t UNION ALL SELECT server, NULL, 'TOTAL', sum(w), count(*), 'SERVER' FROM t GROUP BY server
          UNION ALL SELECT NULL, NULL, 'TOTAL', sum(w), count(*), 'ALL' FROM t)
    SELECT server, table_schema, table_name, level, level <> 'TABLE' AS is_total, n * 1000 AS rows_day,
           CAST(n * 1000 * 90 AS VARCHAR) AS total_rows,
           round(w * 1000 * 1.2::DOUBLE / 1048576, 4) AS data_mb_day,
           round(w * 1000 * 1.2::DOUBLE / 1048576 * 0.3::DOUBLE, 4) AS idx_mb_day,
           round(w * 1000 * 1.2::DOUBLE / 1048576 + w * 1000 * 1.2::DOUBLE / 1048576 * 0.3::DOUBLE, 4) AS total_mb_day,
           round(w * 1000 * 1.2::DOUBLE / 1048576 * 1.3::DOUBLE * 30 / 1024, 2) AS total_gb_month,
           round(w * 1000 * 1.2::DOUBLE / 1048576 * 1.3::DOUBLE * 90 / 1024, 2) AS retention_gb,
           round(w * 1000 * 1.2::DOUBLE / 1048576 * 1.3::DOUBLE * 90 * 1048576 / 8589934592 * 100, 2) AS pool_pct
    FROM r
    """,
)
def storage_projection(spark, sf_dir):
    out = storage.storage_projection(frame(spark, sf_dir, "cat_columns"), 1000, retention_days=90, server_totals=True)
    return out.withColumn("total_rows", F.col("total_rows").cast("string"))


@query(
    "storage_projection_by_index",
    """
    WITH i AS (SELECT server, table_schema, table_name, count(DISTINCT index_name) - 1 AS n FROM {cat_stats} GROUP BY ALL),
    t AS (SELECT server, table_schema, table_name, CAST(sum(CASE WHEN data_type IN ('tinyint','bool') THEN 1 WHEN data_type = 'smallint' THEN 2
        WHEN data_type = 'int' THEN 4 WHEN data_type = 'bigint' THEN 8 WHEN data_type IN ('datetime','timestamp') THEN 8
        WHEN char_octet_length IS NOT NULL AND data_type NOT LIKE '%text%' THEN char_octet_length WHEN data_type = 'tinytext' THEN 255
        WHEN data_type = 'text' THEN 1000 WHEN data_type = 'mediumtext' THEN 5000 WHEN data_type = 'longtext' THEN 10000 ELSE 8 END) AS DOUBLE) AS w
        FROM {cat_columns} GROUP BY ALL),
    b AS (SELECT server, table_schema, table_name, coalesce(n, -1) AS n, w * 200000 * 1.2::DOUBLE / 1048576 AS base FROM t LEFT JOIN i USING (server, table_schema, table_name))
    SELECT server, table_schema, table_name, n AS secondary_indexes, 200000 AS daily_rows,
        round(base * (1 + 0.3::DOUBLE * n), 2) AS daily_total_mb, round(base * (1 + 0.3::DOUBLE * n) / 1024, 2) AS daily_total_gb,
        round(base * (1 + 0.3::DOUBLE * n) * 30 / 1024, 2) AS monthly_total_gb,
        round(base * (30 + 0.3::DOUBLE * n) / 1024, 2) AS monthly_total_gb_literal,
        6000000 AS monthly_estimated_rows,
        round(base * (1 + 0.3::DOUBLE * n) * 30 / 1024, 2) AS total_retention_gb
    FROM b
    """,
)
def storage_projection_by_index(spark, sf_dir):
    return storage.storage_projection_by_index(frame(spark, sf_dir, "cat_columns"), frame(spark, sf_dir, "cat_stats"), 200000)


@query(
    "table_sizes",
    """
    SELECT concat('db', CAST(o_custkey % 3 AS VARCHAR)) AS server, 'sales' AS table_schema, concat('ord', CAST(o_orderkey AS VARCHAR)) AS table_name,
           round(floor(o_totalprice) * 1000 / 1048576, 2) AS data_mb, round(floor(o_totalprice) * 300 / 1048576, 2) AS index_mb, o_custkey AS table_rows
    FROM orders
    """,
)
def table_sizes(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("db"), (F.col("o_custkey") % 3).cast("string")).alias("server"),
        F.lit("sales").alias("table_schema"),
        F.concat(F.lit("ord"), F.col("o_orderkey").cast("string")).alias("table_name"),
        (F.floor("o_totalprice") * 1000).alias("data_bytes"),
        (F.floor("o_totalprice") * 300).alias("index_bytes"),
        F.col("o_custkey").alias("table_rows"),
    )
    return storage.table_sizes(facts)


@query(
    "index_sizes",
    """
    SELECT DISTINCT s.server, s.table_schema, s.table_name, s.index_name, round(o_custkey * 16384 / 1048576.0::DOUBLE, 2) AS index_mb
    FROM {cat_stats} s LEFT JOIN (SELECT *, concat('ord', CAST(o_orderkey AS VARCHAR)) AS t FROM orders) o
        ON s.table_name = o.t AND s.table_schema = 'sales' AND s.index_name = 'idx_cust'
    """,
)
def index_sizes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stats = orders.select(
        F.concat(F.lit("srv"), (F.col("o_custkey") % 3).cast("string")).alias("server"),
        F.lit("sales").alias("table_schema"),
        F.concat(F.lit("ord"), F.col("o_orderkey").cast("string")).alias("table_name"),
        F.lit("idx_cust").alias("index_name"),
        F.explode(F.array(F.struct(F.lit("size").alias("n"), F.col("o_custkey").alias("v")),
                          F.struct(F.lit("n_leaf_pages").alias("n"), F.lit(1).cast("long").alias("v")))).alias("e"),
    ).select("server", "table_schema", "table_name", "index_name", F.col("e.n").alias("stat_name"), F.col("e.v").alias("stat_value"))
    return storage.index_sizes(frame(spark, sf_dir, "cat_stats"), stats)
