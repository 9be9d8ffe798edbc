"""Input frames derived from the given tables."""

from bindings.registry import FRAMES, PLANS, table

# One session per order: 100 consecutive keys share a server, 500 share a snapshot.
_PLACE = """
    concat('db', CAST(CAST(floor(o_orderkey / 100) AS BIGINT) % 5 AS STRING)) AS server,
    TIMESTAMP '2024-01-01 00:00:00' + CAST(floor(o_orderkey / 500) AS BIGINT) * INTERVAL '1' HOUR AS snapshot_ts
"""

FRAMES["sessions"] = f"""
SELECT {_PLACE},
    o_orderkey AS id,
    CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 17 = 1 THEN 'mysql.sys'
         ELSE concat('app', CAST(o_custkey % 17 AS STRING)) END AS user,
    CASE CAST(o_custkey % 4 AS INT)
        WHEN 0 THEN concat('10.0.0.', CAST(o_custkey % 6 AS STRING), ':', CAST(40000 + o_orderkey % 1000 AS STRING))
        WHEN 1 THEN concat('[2001:db8::', CAST(o_custkey % 6 AS STRING), ']:', CAST(40000 + o_orderkey % 1000 AS STRING))
        WHEN 2 THEN concat('2001:db8::', CAST(o_custkey % 6 AS STRING), ':', CAST(40000 + o_orderkey % 1000 AS STRING))
        ELSE concat('node', CAST(o_custkey % 6 AS STRING), '.rack.zone.dc.example.com') END AS host,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('shop_', CAST(o_custkey % 3 AS STRING)) END AS db,
    CASE WHEN o_orderstatus = 'F' THEN 'Sleep' ELSE 'Query' END AS command,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS time,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS state,
    CASE WHEN o_orderstatus = 'F' THEN NULL
         ELSE concat('SELECT *', chr(10), chr(9), 'FROM ord', CAST(o_orderkey AS STRING), ' WHERE prio = ''', o_orderpriority, ''' AND cust = ', CAST(o_custkey AS STRING)) END AS info
FROM {{orders}}
"""

FRAMES["trx"] = f"""
SELECT {_PLACE},
    concat('trx', CAST(o_orderkey AS STRING)) AS trx_id,
    o_orderkey AS thread_id,
    TIMESTAMP '2024-01-01 00:00:00' + CAST(floor(o_orderkey / 500) AS BIGINT) * INTERVAL '1' HOUR
        - (o_orderkey % 400) * INTERVAL '1' SECOND AS trx_started,
    TIMESTAMP '2024-01-01 00:00:00' + CAST(floor(o_orderkey / 500) AS BIGINT) * INTERVAL '1' HOUR
        - (o_orderkey % 90) * INTERVAL '1' SECOND AS trx_wait_started,
    CASE WHEN o_orderkey % 5 = 0 THEN 'RUNNING' ELSE 'LOCK WAIT' END AS trx_state,
    o_orderkey % 20000 AS rows_locked,
    o_custkey % 100 AS rows_modified,
    concat('UPDATE stock SET qty = qty - 1 WHERE id = ', CAST(o_custkey AS STRING)) AS query
FROM {{orders}}
WHERE o_orderpriority <> '5-LOW'
"""

FRAMES["threads"] = f"""
SELECT {_PLACE},
    o_orderkey + 1000000 AS thread_id,
    o_orderkey AS processlist_id,
    CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE concat('thr', CAST(o_custkey % 17 AS STRING)) END AS user,
    concat('host', CAST(o_custkey % 5 AS STRING)) AS host,
    CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('shop_', CAST(o_custkey % 4 AS STRING)) END AS db,
    CASE WHEN o_orderstatus = 'F' THEN 'Sleep' ELSE 'Execute' END AS command,
    CAST(floor(o_totalprice / 900) AS BIGINT) AS time,
    CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'updating' END AS state
FROM {{orders}}
WHERE o_orderpriority <> '4-NOT SPECIFIED'
"""

FRAMES["trx_events"] = f"""
SELECT {_PLACE},
    o_orderkey + 1000000 AS thread_id,
    o_orderkey * 3 AS event_id,
    CASE WHEN o_custkey % 3 = 0 THEN 'COMMITTED' ELSE 'ACTIVE' END AS state,
    (o_orderkey % 900) * 999500000000 AS timer_wait
FROM {{orders}}
WHERE o_orderpriority <> '3-MEDIUM'
"""

FRAMES["statements"] = f"""
SELECT {_PLACE},
    o_orderkey + 1000000 AS thread_id,
    o_orderkey * 5 AS event_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'statement/sql/select' ELSE 'statement/sql/update' END AS event_name,
    CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey * 5 + 1 END AS end_event_id,
    CASE WHEN o_custkey % 6 = 0 THEN '' WHEN o_custkey % 6 = 1 THEN NULL ELSE md5(CAST(o_custkey AS STRING)) END AS digest,
    CASE WHEN o_custkey % 7 = 0 THEN NULL
         ELSE concat('SELECT a,', chr(13), chr(10), chr(9), 'b FROM item', CAST(o_custkey AS STRING), ' WHERE k = ', CAST(o_orderkey AS STRING)) END AS sql_text,
    concat('shop_', CAST(o_custkey % 3 AS STRING)) AS current_schema,
    o_custkey * 2 AS rows_examined,
    o_custkey % 50 AS rows_affected,
    (o_custkey % 700) * 1000300000 AS timer_wait
FROM {{orders}}
WHERE o_orderstatus <> 'P'
"""

# Every order that is not the first of its group of five waits for that first one.
FRAMES["lock_waits"] = f"""
SELECT {_PLACE},
    o_orderkey - o_orderkey % 5 AS blocking_pid,
    o_orderkey AS waiting_pid,
    'shop' AS locked_schema,
    concat('item', CAST(o_custkey % 9 AS STRING)) AS locked_table,
    o_orderkey % 90 AS wait_age_secs,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('DELETE FROM item', chr(10), 'WHERE id = ', CAST(o_custkey AS STRING)) END AS blocking_query,
    concat('UPDATE item SET n = n + 1 WHERE id = ', CAST(o_custkey AS STRING), ' AND part = ', CAST(o_orderkey AS STRING)) AS waiting_query,
    concat('trx', CAST(o_orderkey - o_orderkey % 5 AS STRING)) AS blocking_trx_id,
    concat('trx', CAST(o_orderkey AS STRING)) AS requesting_trx_id,
    concat('lock', CAST(o_orderkey - o_orderkey % 5 AS STRING)) AS blocking_lock_id,
    concat('lock', CAST(o_orderkey AS STRING)) AS requested_lock_id
FROM {{orders}}
WHERE o_orderkey % 5 <> 0
"""

FRAMES["locks"] = f"""
SELECT {_PLACE},
    concat('lock', CAST(o_orderkey AS STRING)) AS lock_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'X' ELSE 'S' END AS lock_mode,
    'RECORD' AS lock_type,
    concat('shop.item', CAST(o_custkey % 9 AS STRING)) AS lock_table,
    CASE WHEN o_custkey % 4 = 0 THEN 'PRIMARY' ELSE 'idx_item' END AS lock_index
FROM {{orders}}
"""

# Event stream as sessions: a snapshot per hour, a user and a kind per session.
FRAMES["event_sessions"] = """
SELECT concat('db', CAST(event_id % 3 AS STRING)) AS server,
       date_trunc('hour', ts) AS snapshot_ts,
       CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('u', CAST(user_id % 10 AS STRING)) END AS user,
       event_type AS db
FROM {events}
"""

# Cumulative counters: two per event, always one sample per counter and time.
FRAMES["counters"] = """
SELECT concat('db', CAST(user_id % 4 AS STRING)) AS server, ts, concat('com_', event_type) AS name,
       CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id * 1000 + CAST(floor(value) AS BIGINT) END AS value
FROM {events}
"""

# Proxy sessions: one per line item.
FRAMES["proxy_sessions"] = """
SELECT l_orderkey * 10 + l_linenumber AS session_id,
       CAST(l_suppkey % 4 AS INT) AS hostgroup,
       CASE WHEN l_suppkey % 12 = 0 THEN 'monitor' WHEN l_suppkey % 12 = 1 THEN NULL ELSE concat('svc', CAST(l_suppkey % 12 AS STRING)) END AS user,
       concat('10.1.0.', CAST(l_partkey % 8 AS STRING)) AS cli_host,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('backend', CAST(l_suppkey % 3 AS STRING), ':3306') END AS srv_host,
       CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN 'N/A' ELSE 'shop' END AS db,
       CAST(floor(l_extendedprice / 20) AS BIGINT) AS time_ms,
       CASE WHEN l_linestatus = 'F' THEN '' WHEN l_linenumber = 7 THEN NULL
            ELSE concat('SELECT', chr(10), '*', chr(9), 'FROM  part', CAST(l_partkey % 40 AS STRING), ' WHERE id=', CAST(l_partkey AS STRING), ' ') END AS info
FROM {lineitem}
"""

# A catalog that grows with the tables: one table per customer, order, part and line item.
FRAMES["cat_columns"] = """
SELECT * FROM (
    SELECT concat('srv', CAST(c_custkey % 3 AS STRING)) AS server, 'crm' AS table_schema, concat('cust', CAST(c_custkey AS STRING)) AS table_name,
           'id' AS column_name, 1 AS ordinal, 'bigint unsigned' AS column_type, 'bigint' AS data_type, 'NO' AS is_nullable,
           CAST(NULL AS BIGINT) AS char_octet_length, 20 AS numeric_precision, CAST(NULL AS STRING) AS character_set, CAST(NULL AS STRING) AS collation
    FROM {customer}
    UNION ALL
    SELECT concat('srv', CAST(c_custkey % 3 AS STRING)), 'crm', concat('cust', CAST(c_custkey AS STRING)),
           'c_name', 2, 'varchar(25)', 'varchar', 'YES', 100, NULL, 'utf8mb4', 'utf8mb4_general_ci'
    FROM {customer}
    UNION ALL
    SELECT concat('srv', CAST(c_custkey % 3 AS STRING)), 'crm', concat('cust', CAST(c_custkey AS STRING)),
           'c_acctbal', 3, 'decimal(13,2)', 'decimal', 'YES', NULL, 13, NULL, NULL
    FROM {customer}
    UNION ALL
    SELECT concat('srv', CAST(o_custkey % 3 AS STRING)), 'sales', concat('ord', CAST(o_orderkey AS STRING)),
           CASE WHEN o_orderkey % 20 = 0 THEN 'ord_key' ELSE concat('ord', CAST(o_orderkey AS STRING), '_key') END, 1, 'bigint', 'bigint', 'NO', NULL, 19, NULL, NULL
    FROM {orders}
    UNION ALL
    SELECT concat('srv', CAST(o_custkey % 3 AS STRING)), 'sales', concat('ord', CAST(o_orderkey AS STRING)),
           concat('cust', CAST(o_custkey AS STRING), '_id'), 2,
           CASE WHEN o_orderkey % 4 = 0 THEN 'int' ELSE 'bigint unsigned' END, CASE WHEN o_orderkey % 4 = 0 THEN 'int' ELSE 'bigint' END,
           'YES', NULL, 20, NULL, NULL
    FROM {orders}
    UNION ALL
    SELECT concat('srv', CAST(o_custkey % 3 AS STRING)), 'sales', concat('ord', CAST(o_orderkey AS STRING)),
           'placed', 3, 'datetime', 'datetime', 'YES', NULL, NULL, NULL, NULL
    FROM {orders}
    UNION ALL
    SELECT concat('srv', CAST(o_custkey % 3 AS STRING)), 'sales', concat('ord', CAST(o_orderkey AS STRING)),
           'note', 4, CASE WHEN o_orderkey % 2 = 0 THEN 'text' ELSE 'enum(''a'',''b'')' END, CASE WHEN o_orderkey % 2 = 0 THEN 'text' ELSE 'enum' END,
           'YES', CASE WHEN o_orderkey % 2 = 0 THEN 65535 ELSE 4 END, NULL, 'utf8mb4', 'utf8mb4_general_ci'
    FROM {orders}
    UNION ALL
    SELECT concat('srv', CAST(p_partkey % 3 AS STRING)), 'stock', concat('part', CAST(p_partkey AS STRING)),
           concat('part', CAST(p_partkey AS STRING), '_no'), 1, 'int', 'int', 'NO', NULL, 10, NULL, NULL
    FROM {part}
    UNION ALL
    SELECT concat('srv', CAST(p_partkey % 3 AS STRING)), 'stock', concat('part', CAST(p_partkey AS STRING)),
           'brand_no', 2, 'varchar(10)', 'varchar', 'NO', 40, NULL, 'utf8mb4', 'utf8mb4_bin'
    FROM {part}
    UNION ALL
    SELECT concat('srv', CAST(p_partkey % 3 AS STRING)), 'archive', concat('part', CAST(p_partkey AS STRING), 'old'),
           concat('part', CAST(p_partkey AS STRING), '_no'), 1, 'int', 'int', 'NO', NULL, 10, NULL, NULL
    FROM {part}
    WHERE p_size > 40
    UNION ALL
    SELECT concat('srv', CAST(l_partkey % 3 AS STRING)), 'sales', concat('line', CAST(l_orderkey AS STRING), 'n', CAST(row_no AS STRING)),
           concat('part', CAST(l_partkey AS STRING), '_no'), 1, CASE WHEN l_returnflag = 'A' THEN 'bigint' ELSE 'int' END,
           CASE WHEN l_returnflag = 'A' THEN 'bigint' ELSE 'int' END, 'YES', NULL, 10, NULL, NULL
    FROM {line_tables}
    UNION ALL
    SELECT concat('srv', CAST(l_partkey % 3 AS STRING)), 'sales', concat('line', CAST(l_orderkey AS STRING), 'n', CAST(row_no AS STRING)),
           'brand_no', 2, 'varchar(10)', 'varchar', 'YES', 40, NULL, 'utf8mb4', CASE WHEN l_linestatus = 'F' THEN 'utf8mb4_general_ci' ELSE 'utf8mb4_bin' END
    FROM {line_tables}
    WHERE l_linenumber > 2
) all_columns
"""

# Line items have repeated (order, line) pairs, so the part key is part of the table's name.
FRAMES["line_tables"] = """
SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus,
       concat(CAST(l_linenumber AS STRING), 'p', CAST(l_partkey AS STRING), l_returnflag, l_linestatus) AS row_no
FROM {lineitem}
"""


def _line_tables(spark, sf_dir):
    """The same rows: the name follows from the other columns, so rows are told apart without it."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus").distinct()
    return rows.selectExpr("*", "concat(CAST(l_linenumber AS STRING), 'p', CAST(l_partkey AS STRING), l_returnflag, l_linestatus) AS row_no")


PLANS["line_tables"] = _line_tables

FRAMES["cat_pks"] = """
SELECT concat('srv', CAST(c_custkey % 3 AS STRING)) AS server, 'crm' AS constraint_schema, concat('cust', CAST(c_custkey AS STRING)) AS table_name, 'id' AS column_name, 1 AS ordinal FROM {customer}
UNION ALL
SELECT concat('srv', CAST(o_custkey % 3 AS STRING)), 'sales', concat('ord', CAST(o_orderkey AS STRING)), CASE WHEN o_orderkey % 20 = 0 THEN 'ord_key' ELSE concat('ord', CAST(o_orderkey AS STRING), '_key') END, 1 FROM {orders}
UNION ALL
SELECT concat('srv', CAST(p_partkey % 3 AS STRING)), 'stock', concat('part', CAST(p_partkey AS STRING)), concat('part', CAST(p_partkey AS STRING), '_no'), 1 FROM {part}
UNION ALL
SELECT concat('srv', CAST(p_partkey % 3 AS STRING)), 'stock', concat('part', CAST(p_partkey AS STRING)), 'brand_no', 2 FROM {part} WHERE p_size % 2 = 0
UNION ALL
SELECT concat('srv', CAST(p_partkey % 3 AS STRING)), 'archive', concat('part', CAST(p_partkey AS STRING), 'old'), concat('part', CAST(p_partkey AS STRING), '_no'), 1 FROM {part} WHERE p_size > 40
"""

FRAMES["cat_stats"] = """
SELECT server, constraint_schema AS table_schema, table_name, 'PRIMARY' AS index_name, 0 AS non_unique, ordinal AS seq_in_index, column_name,
       CAST(100 + ordinal AS BIGINT) AS cardinality, 1 AS index_ordinal
FROM {cat_pks}
UNION ALL
SELECT concat('srv', CAST(o_custkey % 3 AS STRING)), 'sales', concat('ord', CAST(o_orderkey AS STRING)), 'idx_cust', 1, 1,
       concat('cust', CAST(o_custkey AS STRING), '_id'), o_custkey, 2
FROM {orders} WHERE o_orderstatus <> 'F'
UNION ALL
SELECT concat('srv', CAST(o_custkey % 3 AS STRING)), 'sales', concat('ord', CAST(o_orderkey AS STRING)), 'idx_cust', 1, 2, 'placed', o_custkey + 1, 2
FROM {orders} WHERE o_orderstatus <> 'F'
UNION ALL
SELECT concat('srv', CAST(o_custkey % 3 AS STRING)), 'sales', concat('ord', CAST(o_orderkey AS STRING)), 'uq_placed', 0, 1, 'placed', o_custkey + 2, 3
FROM {orders} WHERE o_orderpriority = '1-URGENT'
UNION ALL
SELECT concat('srv', CAST(l_partkey % 3 AS STRING)), 'sales', concat('line', CAST(l_orderkey AS STRING), 'n', CAST(row_no AS STRING)), 'idx_part', 1, 1,
       CASE WHEN l_linenumber > 4 THEN 'brand_no' ELSE concat('part', CAST(l_partkey AS STRING), '_no') END, 42, 1
FROM {line_tables} WHERE l_linenumber > 2
UNION ALL
SELECT concat('srv', CAST(l_partkey % 3 AS STRING)), 'sales', concat('line', CAST(l_orderkey AS STRING), 'n', CAST(row_no AS STRING)), 'idx_part', 1, 2,
       CASE WHEN l_linenumber > 4 THEN concat('part', CAST(l_partkey AS STRING), '_no') ELSE 'brand_no' END, 43, 1
FROM {line_tables} WHERE l_linenumber > 2
"""

FRAMES["cat_fks"] = """
SELECT concat('srv', CAST(o_custkey % 3 AS STRING)) AS server, concat('fk_', CAST(o_orderkey AS STRING)) AS constraint_name, 'sales' AS constraint_schema,
       concat('ord', CAST(o_orderkey AS STRING)) AS table_name, concat('cust', CAST(o_custkey AS STRING), '_id') AS column_name,
       'crm' AS ref_schema, concat('cust', CAST(o_custkey AS STRING)) AS ref_table, 'id' AS ref_column, 1 AS ordinal,
       'CASCADE' AS update_rule, 'RESTRICT' AS delete_rule
FROM {orders} WHERE o_orderstatus = 'P' AND o_custkey < 1000000000
UNION ALL
SELECT concat('srv', CAST(l_partkey % 3 AS STRING)), concat('fkl_', CAST(l_orderkey AS STRING), 'n', row_no), 'sales',
       concat('line', CAST(l_orderkey AS STRING), 'n', row_no), concat('part', CAST(l_partkey AS STRING), '_no'),
       'stock', concat('part', CAST(l_partkey AS STRING)), concat('part', CAST(l_partkey AS STRING), '_no'), 1, 'NO ACTION', 'SET NULL'
FROM {line_tables} WHERE l_linenumber = 6
UNION ALL
SELECT concat('srv', CAST(l_partkey % 3 AS STRING)), concat('fkl_', CAST(l_orderkey AS STRING), 'n', row_no), 'sales',
       concat('line', CAST(l_orderkey AS STRING), 'n', row_no), 'brand_no',
       'stock', concat('part', CAST(l_partkey AS STRING)), 'brand_no', 2, 'NO ACTION', 'SET NULL'
FROM {line_tables} WHERE l_linenumber = 6
"""
