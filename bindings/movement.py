"""Upserts, archiving, partition layout, change sets, retention, catalog search and text functions."""

from pyspark.sql import functions as F

from bindings.registry import FRAMES, frame, query, table
from opslens.functions import statements as st
from opslens.functions import text, units
from opslens.operators import catalog_search, movement
from opslens.session import scratch_dir

FRAMES["growth_updates"] = """
SELECT o_orderkey, o_custkey + 7 AS o_custkey, o_orderstatus, o_totalprice + copy AS o_totalprice, copy
FROM (SELECT *, 1 AS copy FROM {orders} WHERE o_orderkey % 10 = 0 UNION ALL SELECT *, 2 AS copy FROM {orders} WHERE o_orderkey % 20 = 0
      UNION ALL SELECT o_orderkey + 100000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 1 AS copy FROM {orders} WHERE o_orderstatus = 'P') u
"""


_UPSERTED = """
    WITH u AS (SELECT * EXCLUDE (copy) FROM {growth_updates} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY copy DESC) = 1)
    SELECT * FROM u UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)
    """


@query("upsert", _UPSERTED)
def upsert(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return movement.upsert(target, frame(spark, sf_dir, "growth_updates"), ["o_orderkey"], ["copy"])


@query("merge_into_target", _UPSERTED)
def merge_into_target(spark, sf_dir):
    """The orders as a published target, the same updates merged twice: the second time nothing is rewritten."""
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.lit(-1).cast("long").alias("copy"))
    updates = frame(spark, sf_dir, "growth_updates").select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    root = scratch_dir(spark, "orders-target")
    for rows in (target, updates, updates):
        rewritten = movement.merge_into(spark, root, rows, ["o_orderkey"], ["copy"], 16)
    if rewritten:
        raise ValueError(f"a repeated merge has rewritten {rewritten}")
    return movement.read_target(spark, root, target.schema).drop("copy")


@query(
    "month_chunks",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(min(o_orderdate), '%Y-%m-%d') AS first_ts, min(o_orderkey) AS first_id, strftime(max(o_orderdate), '%Y-%m-%d') AS last_ts,
        max(o_orderkey) AS last_id, count(o_orderkey) AS rows FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1""",
)
def month_chunks(spark, sf_dir):
    out = movement.month_chunks(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", "1996-02-01", "1999-01-01")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.withColumn("first_ts", day("first_ts")).withColumn("last_ts", day("last_ts"))


_ARCHIVED = """
    WITH c AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY strftime(ts, '%Y-%m')),
    m AS (SELECT event_id, user_id, event_type FROM events JOIN c ON event_id BETWEEN lo AND hi)
    SELECT * FROM m UNION ALL SELECT event_id, -1, 'old' FROM events WHERE event_id % 3 = 0 AND event_id NOT IN (SELECT event_id FROM m)
    """


@query("archive_range", _ARCHIVED)
def archive_range(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    archive = events.filter("event_id % 3 = 0").select("event_id", F.lit(-1).cast("long").alias("user_id"), F.lit("old").alias("event_type"))
    rows = events.select("event_id", "user_id", "event_type", "ts")
    dest = archive.withColumn("ts", F.lit(None).cast(rows.schema["ts"].dataType))
    return movement.archive_range(rows, dest, "ts", "event_id", "2024-01-10", "2024-01-20").drop("ts")


@query("archive_into_target", _ARCHIVED)
def archive_into_target(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select("event_id", "user_id", "event_type", "ts")
    kind = rows.schema["ts"].dataType
    older = events.filter("event_id % 3 = 0").select("event_id", F.lit(-1).cast("long").alias("user_id"), F.lit("old").alias("event_type"), F.lit(None).cast(kind).alias("ts"))
    root = scratch_dir(spark, "archive-target")
    movement.merge_into(spark, root, older, ["event_id"], ["ts"], 16)
    for _ in range(2):
        rewritten = movement.archive_into(spark, rows, root, "ts", "event_id", "2024-01-10", "2024-01-20", buckets=16)
    if rewritten:
        raise ValueError(f"a repeated run has rewritten {rewritten}")
    return movement.read_target(spark, root, rows.schema).drop("ts")


@query(
    "partition_layout",
    """
    WITH RECURSIVE p AS (SELECT TIMESTAMP '1995-01-01' AS f UNION ALL SELECT f + INTERVAL 1 MONTH FROM p WHERE f < TIMESTAMP '2004-12-01'),
    c AS (SELECT date_trunc('month', o_orderdate) AS f, count(*) AS rows FROM orders GROUP BY 1)
    SELECT 'p' || strftime(p.f, '%Y%m') AS name, strftime(p.f + INTERVAL 1 MONTH, '%Y-%m-%d') AS less_than, coalesce(rows, 0) AS rows FROM p LEFT JOIN c ON c.f = p.f
    """,
)
def partition_layout(spark, sf_dir):
    plan = movement.partition_plan(spark, "1995-01-15", 120, "month")
    key = movement.partition_key(F.col("o_orderdate"), "month").alias("name")
    counts = table(spark, sf_dir, "orders").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return plan.join(counts, "name", "left").select(
        "name", F.col("less_than").cast("string").alias("less_than"), F.coalesce("n", F.lit(0)).alias("rows")
    )


def _change(op: str, sql: str) -> None:
    @query(f"change_set_{op.lower()}", f"SELECT '{op}' AS op, c_custkey AS key, {sql} AS statement FROM customer")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, "O'Neil").when(F.col("c_custkey") % 5 == 1, "").otherwise(F.col("c_name")))
        return movement.change_set(rows, op, "crm.customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey"])


_CUST = "CASE c_custkey % 5 WHEN 0 THEN '''O''''Neil''' WHEN 1 THEN 'NULL' ELSE '''' || c_name || '''' END"
_change("INSERT", f"'INSERT IGNORE INTO crm.customer (c_custkey,c_name,c_nationkey) VALUES (' || c_custkey || ', ' || {_CUST} || ', ' || c_nationkey || ');'")
_change("UPDATE", f"'UPDATE crm.customer SET c_name = ' || {_CUST} || ', c_nationkey = ' || c_nationkey || ' WHERE c_custkey = ' || c_custkey || ';'")
_change("DELETE", "'DELETE FROM crm.customer WHERE c_custkey = ' || c_custkey || ';'")


@query("delete_range", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderkey BETWEEN 100 AND 1099)")
def delete_range(spark, sf_dir):
    return movement.delete_range(table(spark, sf_dir, "orders"), "o_orderkey", 100, 1000).select("o_orderkey", "o_custkey")


@query(
    "delete_range_workers",
    """
    WITH b AS (SELECT greatest(500, min(o_orderkey)) AS lo, least(500 + 1000000000 - 1, max(o_orderkey)) AS hi FROM orders), n AS (SELECT *, hi - lo + 1 AS n FROM b),
    w AS (SELECT unnest(range(1, 8)) AS worker, lo, n, n // 7 AS share, n % 7 AS rest FROM n)
    SELECT CAST(worker AS INTEGER) AS worker, lo + (worker - 1) * share + least(worker - 1, rest) AS first_id,
        lo + (worker - 1) * share + least(worker - 1, rest) + share + CASE WHEN worker <= rest THEN 1 ELSE 0 END - 1 AS last_id, share + CASE WHEN worker <= rest THEN 1 ELSE 0 END AS keys FROM w
    """,
)
def delete_range_workers(spark, sf_dir):
    return movement.split_range(table(spark, sf_dir, "orders"), "o_orderkey", 500, 10**9, 7)


@query(
    "load_audit",
    """
    WITH e AS (SELECT o_custkey % 50 AS part, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END) AS BIGINT) AS expected FROM orders GROUP BY 1), a AS (SELECT o_custkey % 50 AS part, count(*) AS actual FROM orders WHERE o_custkey % 50 <> 3 GROUP BY 1)
    SELECT part, expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - expected AS difference, CASE WHEN expected = coalesce(actual, 0) THEN 'OK' ELSE 'MISMATCH' END AS status FROM e LEFT JOIN a USING (part)
    """,
)
def load_audit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("part", F.col("o_custkey") % 50)
    expected = orders.select("part", F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("rows"))
    return movement.load_audit(expected, orders.filter("part <> 3"), ["part"])


@query(
    "retention_plan",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, date_diff('day', min(ts)::DATE, DATE '2024-02-01') AS age_days,
        CASE WHEN date_diff('day', min(ts)::DATE, DATE '2024-02-01') > 20 THEN 'REMOVE' WHEN date_diff('day', min(ts)::DATE, DATE '2024-02-01') > 7 THEN 'COMPRESS' ELSE 'KEEP' END AS action FROM events GROUP BY 1""",
)
def retention_plan(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    plan = movement.retention_plan(days, "day", F.lit("2024-02-01").cast("date"), 7, 20)
    return plan.withColumn("age_days", F.col("age_days").cast("long"))


_OLD = "SELECT o_custkey % 40 AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_custkey % 40 AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 <> 0"


def _dumps(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("k"), F.col("o_orderstatus").alias("s"), "o_orderkey")
    return rows.filter("o_orderkey % 3 <> 0").drop("o_orderkey"), rows.filter("o_orderkey % 4 <> 0").drop("o_orderkey")


@query(
    "snapshot_diff",
    f"""WITH o AS (SELECT k, s, count(*) AS n FROM ({_OLD}) GROUP BY ALL), n AS (SELECT k, s, count(*) AS n FROM ({_NEW}) GROUP BY ALL)
    SELECT k, s, CASE WHEN coalesce(o.n, 0) > coalesce(n.n, 0) THEN '-' ELSE '+' END AS change, abs(coalesce(o.n, 0) - coalesce(n.n, 0)) AS copies FROM o FULL JOIN n USING (k, s) WHERE coalesce(o.n, 0) <> coalesce(n.n, 0)""",
)
def snapshot_diff(spark, sf_dir):
    return movement.snapshot_diff(*_dumps(spark, sf_dir))


@query(
    "snapshot_diff_keyed",
    """
    WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT o_orderkey, CASE WHEN n.o_orderstatus IS NULL THEN '-' WHEN o.o_orderstatus IS NULL THEN '+' ELSE 'CHANGED' END AS change FROM o FULL JOIN n USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM n.o_orderstatus
    """,
)
def snapshot_diff_keyed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    old = rows.filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus")
    new = rows.filter("o_orderkey % 4 <> 0").select(
        "o_orderkey", F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    )
    return movement.snapshot_diff(old, new, ["o_orderkey"])


# --- catalog objects ------------------------------------------------------------------------------

FRAMES["objects"] = """
SELECT concat('srv', CAST(c_custkey % 5 AS STRING)) AS server, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'TABLE' WHEN 1 THEN 'TRIGGER' WHEN 2 THEN 'PROCEDURE' ELSE 'VIEW' END AS kind,
       CASE WHEN c_nationkey = 3 THEN 'mysql' ELSE 'crm' END AS schema_name, concat(CASE WHEN c_custkey % 4 = 0 THEN 'obj' ELSE 'other' END, CAST(c_custkey % 30 AS STRING)) AS name, c_mktsegment AS type,
       concat('obj', CAST(c_nationkey AS STRING)) AS bound, concat('BEGIN update obj', CAST(c_nationkey AS STRING), ' END') AS body, c_custkey AS object_id
FROM {customer}
"""


def _objects(spark, sf_dir):
    rows = frame(spark, sf_dir, "objects")
    attrs = F.create_map(F.lit("table"), F.col("bound"), F.lit("body"), F.col("body"))
    return rows.withColumnRenamed("schema_name", "schema").withColumn("attrs", attrs)


@query(
    "catalog_search_exact",
    """SELECT server, kind, name, object_id, CASE WHEN name IN ('obj8', 'obj12') AND kind IN ('TABLE', 'VIEW') THEN 'NAME' WHEN kind = 'TRIGGER' AND bound IN ('obj8', 'obj12') THEN 'BOUND TRIGGER' ELSE 'ACTS ON' END AS match
       FROM {objects} WHERE schema_name <> 'mysql' AND regexp_matches(server, 'srv[0-3]') AND NOT regexp_matches(server, 'srv2')
         AND ((name IN ('obj8', 'obj12') AND kind IN ('TABLE', 'VIEW')) OR (kind = 'TRIGGER' AND bound IN ('obj8', 'obj12')) OR (kind = 'PROCEDURE' AND (contains(body, 'obj8') OR contains(body, 'obj12'))))""",
)
def catalog_search_exact(spark, sf_dir):
    found = catalog_search.catalog_search(
        _objects(spark, sf_dir), "obj8, obj12", ["TABLE", "VIEW"], True, "SRV0,srv1,srv2,srv3", "srv2", related=True
    )
    return found.select("server", "kind", "name", "object_id", "match")


@query("catalog_search_pattern", """SELECT server, kind, name, object_id, 'NAME' AS match FROM {objects} WHERE regexp_matches(name, '(?i)OBJ1|r2$')""")
def catalog_search_pattern(spark, sf_dir):
    found = catalog_search.catalog_search(_objects(spark, sf_dir), "OBJ1,r2$", exact=False, system=True)
    return found.select("server", "kind", "name", "object_id", "match")


FRAMES["privileges"] = """
SELECT concat('srv', CAST(l_suppkey % 3 AS STRING)) AS server, concat('user', CAST(l_suppkey AS STRING)) AS grantee,
       CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'SCHEMA' ELSE 'TABLE' END AS level, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'crm' END AS schema_name,
       CASE WHEN l_partkey % 3 = 2 THEN concat('t', CAST(l_linenumber AS STRING)) ELSE '' END AS table_name,
       CASE WHEN l_partkey % 31 = 0 THEN 'USAGE' ELSE concat('PRIV', CAST(l_partkey % 31 AS STRING)) END AS privilege, CASE WHEN l_orderkey % 50 = 0 THEN 'YES' ELSE 'NO' END AS grantable
FROM {lineitem}
"""


@query(
    "grants_summary",
    """
    WITH d AS (SELECT server, grantee, level, schema_name, table_name, privilege, bool_or(grantable = 'YES') AS g FROM {privileges} WHERE privilege <> 'USAGE' GROUP BY ALL)
    SELECT server, grantee, level, schema_name AS "schema", table_name AS "table", count(*) AS privileges,
        string_agg(privilege, ', ' ORDER BY privilege) AS grants,
        CASE WHEN (level = 'GLOBAL' AND count(*) > 20) OR (level = 'SCHEMA' AND count(*) > 14) THEN CASE WHEN bool_or(g) THEN 'ALL GRANTS WITH GRANT OPTION' ELSE 'ALL GRANTS' END END AS verdict
    FROM d GROUP BY server, grantee, level, schema_name, table_name
    """,
)
def grants_summary(spark, sf_dir):
    rows = frame(spark, sf_dir, "privileges").withColumnsRenamed({"schema_name": "schema", "table_name": "table"})
    return catalog_search.grants_summary(rows)


# --- text and number functions over whole texts ------------------------------------------------------

_ONE = "trim(regexp_replace(regexp_replace(regexp_replace({c}, '\\\\[nrt]', ' ', 'g'), '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g'), '[\\s\\pZ]+', ' ', 'g'))"


@query(
    "document_texts_sanitized",
    f"""SELECT doc_id, md5({_ONE.format(c='text')}) AS clean_hash, length({_ONE.format(c='text')}) AS clean_chars, md5(substr(replace(replace(replace(text, chr(10), ' '), chr(13), ''), chr(9), ' '), 1, 160)) AS short_hash,
        sha256(text) AS text_hash, md5(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '''', ''''''), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r')) AS escaped_hash FROM documents""",
)
def document_texts_sanitized(spark, sf_dir):
    body = F.col("text")
    md5 = lambda c: F.md5(c.cast("binary"))
    clean = text.sanitize_text(body)
    return table(spark, sf_dir, "documents").select(
        "doc_id", md5(clean).alias("clean_hash"), F.char_length(clean).cast("long").alias("clean_chars"), md5(text.one_line(body, 160)).alias("short_hash"),
        st.statement_hash(body).alias("text_hash"), md5(text.log_escape(body)).alias("escaped_hash"),
    )


# The template by lists: tokens of the text without literals, shown one by one, chr(1) where no blank may stand.
_TEMPLATE = r"""
SELECT {key}, CASE WHEN trim(b) = '' THEN left(b, 1) ELSE translate(replace(replace(concat(
    CASE WHEN b LIKE ' %' OR regexp_matches(b, '^([,()=<>]|-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?([ ,()=<>]|$))') THEN ' ' ELSE '' END, j,
    CASE WHEN b LIKE '% ' OR right(j, 1) IN (',', ')', '=', '<', '>', chr(2)) THEN ' ' ELSE '' END), ' ' || chr(1), ''), chr(1) || ' ', ''), chr(1) || chr(2), '') END AS t
FROM (SELECT {key}, b, array_to_string(list_transform(regexp_extract_all(b, ',(?: *,)*|[()=<>]|[^ ,()=<>]+'), lambda x: CASE
    WHEN x LIKE ',%' THEN chr(1) || replace(replace(x, ' ', ''), ',,', ', ,') WHEN x = ')' THEN chr(1) || x WHEN x = '(' THEN x || chr(1)
    WHEN regexp_full_match(x, '-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?') THEN '?' || chr(2) ELSE x END), ' ') AS j
FROM (SELECT {key}, regexp_replace(regexp_replace({column}, '[\x00-\x1f\x7f-\x9f]+', '', 'g'),
    '(_binary *)?(''([^''\\]|\\.)*''|"([^"\\]|\\.)*")|0x[0-9a-fA-F]+|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?)?', '?', 'g') AS b FROM {name}))
"""


def _templates(name: str, key: str, column: str) -> None:
    @query(
        f"{name}_templates",
        f"SELECT {key}, md5(t) AS template, substr(md5(t), 1, 12) AS template_hash, length(t) AS chars FROM ({_TEMPLATE.format(key=key, column=column, name=name)})",
    )
    def run(spark, sf_dir):
        from opslens.plans.staging import settled

        rows = settled(table(spark, sf_dir, name).select(key, column), t=st.sql_template(F.col(column), literal_keywords=False))
        return rows.select(
            key, F.md5(F.col("t").cast("binary")).alias("template"), st.template_hash(F.col("t")).alias("template_hash"),
            F.char_length("t").cast("long").alias("chars"),
        )


_templates("documents", "doc_id", "text")
_templates("pages", "page_id", "html")


@query(
    "value_rendering",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d >= 0 THEN '+' || d ELSE CAST(d AS VARCHAR) END AS signed,
        CASE WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024) ELSE printf('%.0f B', b) END AS size,
        strftime(make_timestamp(1704067200000000 + l_partkey * 1000001), '%Y-%m-%d %H:%M:%S.%f') AS at, strftime(l_shipdate, '%Y-%m') AS month, CAST(epoch(l_shipdate) AS BIGINT) AS epoch_s
       FROM (SELECT *, l_partkey - l_suppkey * 10 AS d, CAST(l_partkey * l_partkey * l_suppkey AS DOUBLE) AS b FROM lineitem)""",
)
def value_rendering(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        text.signed(F.col("l_partkey") - F.col("l_suppkey") * 10).alias("signed"),
        units.human_bytes(units.product(F.col("l_partkey"), F.col("l_partkey"), F.col("l_suppkey"))).alias("size"),
        F.date_format(units.us_to_timestamp(F.lit(1704067200000000) + F.col("l_partkey") * 1000001), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
        units.bucket(F.col("l_shipdate"), "month").alias("month"),
        units.epoch_seconds(F.col("l_shipdate")).alias("epoch_s"),
    )
