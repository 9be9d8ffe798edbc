"""Column layouts of the stored snapshots and logs.

Every snapshot carries ``server`` and ``snapshot_ts``, as the data of many servers is kept together.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_AT = "server string, snapshot_ts timestamp, "

DDL = {
    "catalog_columns": "server string, table_schema string, table_name string, column_name string, ordinal int, "
    "column_type string, data_type string, is_nullable string, char_octet_length long, numeric_precision int, "
    "character_set string, collation string",
    "catalog_statistics": "server string, table_schema string, table_name string, index_name string, non_unique int, "
    "seq_in_index int, column_name string, cardinality decimal(20,0), index_ordinal int",
    "key_column_usage": "server string, constraint_name string, constraint_schema string, table_name string, "
    "column_name string, ordinal int, ref_schema string, ref_table string, ref_column string",
    "table_constraints": "server string, constraint_name string, constraint_schema string, table_name string, constraint_type string",
    "referential_constraints": "server string, constraint_name string, constraint_schema string, table_name string, "
    "update_rule string, delete_rule string",
    "sessions": _AT + "id long, user string, host string, db string, command string, time long, state string, info string",
    "transactions": _AT + "trx_id string, thread_id long, trx_started timestamp, trx_state string, "
    "trx_wait_started timestamp, rows_locked long, rows_modified long, query string",
    "threads": _AT + "thread_id long, processlist_id long, user string, host string, db string, command string, "
    "time long, state string, info string",
    "trx_events": _AT + "thread_id long, event_id long, state string, timer_wait decimal(20,0)",
    "statements": _AT + "thread_id long, event_id long, event_name string, end_event_id long, digest string, "
    "sql_text string, current_schema string, rows_examined long, rows_affected long, timer_wait decimal(20,0)",
    "lock_waits": _AT + "blocking_pid long, waiting_pid long, locked_schema string, locked_table string, "
    "wait_age_secs long, blocking_query string, waiting_query string, blocking_trx_id string, "
    "requesting_trx_id string, blocking_lock_id string, requested_lock_id string",
    "locks": _AT + "lock_id string, lock_mode string, lock_type string, lock_table string, lock_index string",
    "counters": "server string, ts timestamp, name string, value decimal(20,0)",
    "proxy_sessions": _AT + "session_id long, hostgroup int, user string, cli_host string, srv_host string, db string, "
    "time_ms long, info string",
    "proxy_digests": _AT + "digest string, count_star long, sum_time long, min_time long, max_time long, digest_text string",
    "proxy_pool": _AT + "hostgroup int, srv_host string, status string, conn_used long, conn_free long, conn_ok long, conn_err long",
    "proxy_pings": "server string, hostname string, time_start_us long, ping_success_time_us long, ping_error string",
    "doc_ops": _AT + "connectionId long, client string, appName string, ns string, op string, desc string, active boolean, "
    "secs_running long, microsecs_running long, command map<string,string>, planSummary string",
    "pool_stats": _AT + "pool_id int, pool_size long, free_buffers long, database_pages long, modified_database_pages long, "
    "pages_read_rate double, pages_made_young long, pages_not_made_young long",
    "buffer_pages": _AT + "table_name string, index_name string, data_size long, is_old string, is_hashed string",
    "buffer_tables": _AT + "object_schema string, object_name string, pages long, allocated long, data long, "
    "pages_old long, pages_hashed long, rows_cached long",
    "table_sizes": "sample_date date, server string, table_schema string, table_name string, data_bytes long, "
    "index_bytes long, table_rows long",
    "catalog_objects": "server string, kind string, schema string, name string, type string, attrs map<string,string>",
    "privileges": "server string, grantee string, level string, schema string, table string, privilege string, grantable string",
    "incidents": "type string, ts timestamp, user string, host string, thread string, trx string, op string, query string, template string",
    "log_entry": "textPayload string, jsonPayload string, timestamp string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
