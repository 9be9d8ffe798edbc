"""Orderings, unions, small text functions, report files and default values over the given tables.

An ordering is checked by the place that its rows take: the number of a row is read from the sorted frame.
"""

from pyspark.sql import functions as F

from bindings.registry import frame, query, table
from opslens.functions import text
from opslens.operators import engine_status, movement, reports, sessions, topology
from opslens.session import scratch_dir


def _places(df):
    """The sorted rows with their places: written, so that files and rows keep the order of the sort."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "sorted")
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return rows.select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _ordered_pairs(df, *columns):
    """Each row with the one before it, across the files of a sorted dataset."""
    from opslens.plans.ordered import SLICE, carried_lag

    placed = _places(df).withColumn(SLICE, F.col("__file"))
    before = carried_lag(placed, [], ["__row"], {f"before_{c}": c for c in columns})
    return before.select(*columns, *[f"before_{c}" for c in columns])


_AGES = """a AS (SELECT concat('db', CAST(user_id % 4 AS VARCHAR)) AS server, event_id AS id, user_id % 50 AS age_s FROM events)"""


@query(
    "sessions_by_age",
    f"""WITH {_AGES} SELECT server, id, age_s, lag(server) OVER w AS before_server, lag(id) OVER w AS before_id, lag(age_s) OVER w AS before_age_s
        FROM a WINDOW w AS (ORDER BY age_s DESC, server, id)""",
)
def sessions_by_age(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("db"), (F.col("user_id") % 4).cast("string")).alias("server"), F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("age_s"),
    )
    return _ordered_pairs(sessions.by_age(rows), "server", "id", "age_s")


@query(
    "union_of_kinds",
    """SELECT 'customer' AS kind, c_name AS name, c_nationkey AS nation, NULL AS size FROM customer
       UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL FROM supplier UNION ALL SELECT 'part', p_name, NULL, p_size FROM part""",
)
def union_of_kinds(spark, sf_dir):
    """Object kinds with different columns as one frame."""
    return movement.union_all([
        table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")),
        table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")),
        table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("size")),
    ])


@query(
    "document_error_texts",
    r"""SELECT doc_id, CASE WHEN e = '' THEN 'unknown error' ELSE e END AS error, upper(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(t, '^enum\(.*\)$', 'enum') ELSE t END) AS shown_type
        FROM (SELECT doc_id, left(translate(text, chr(10) || chr(13), '  '), 240) AS e,
            CASE doc_id % 3 WHEN 0 THEN 'enum(''' || lang || ''',''b'')' WHEN 1 THEN 'varchar(' || n_chars || ')' ELSE 'bigint' END AS t FROM documents)""",
)
def document_error_texts(spark, sf_dir):
    """Texts in terminal colours, as a client prints them: the escapes go, line ends become blanks."""
    shown = F.concat(F.lit("\x1b[1;31m"), F.replace("text", F.lit("\n"), F.lit("\x1b[0m\n")), F.lit("\x1b[0m"))
    kind = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("enum('"), "lang", F.lit("','b')"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("varchar("), F.col("n_chars").cast("string"), F.lit(")"))).otherwise("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_error(shown, 240).alias("error"), text.display_type(kind).alias("shown_type"))


@query(
    "report_round_trip",
    "SELECT event_id, event_type || ' \"quoted\", ' || event_id AS label, CAST(NULL AS VARCHAR) AS empty FROM events",
)
def report_round_trip(spark, sf_dir):
    """A tab-separated report written, published and read back."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.concat("event_type", F.lit(' "quoted", '), F.col("event_id").cast("string")).alias("label"), F.lit(None).cast("string").alias("empty"),
    )
    root = f"{scratch_dir(spark, 'report')}/events.tsv"
    reports.publish_report(rows, root)
    read = spark.read.option("header", True).option("sep", "\t").option("escape", '"').csv(reports.report_folder(spark, root))
    return read.withColumn("event_id", F.col("event_id").cast("long"))


@query(
    "engine_status_defaults",
    """SELECT event_id, CASE WHEN is_lock THEN 'LOCK' ELSE 'ACTIVE' END AS type, 'nobody' AS "user", 'nobody' AS host, 'nobody' AS thread, trx FROM {sample_facts} WHERE op IS NOT NULL
       UNION ALL SELECT event_id, 'DEADLOCK', 'nobody', 'nobody', 'nobody', trx FROM sample_facts WHERE has_deadlock AND op IS NOT NULL AND file_hour - INTERVAL '9000' SECOND <= deadlock_ts""",
)
def engine_status_defaults(spark, sf_dir):
    """Samples whose thread lines name neither thread nor account: the given default stands in."""
    samples = frame(spark, sf_dir, "samples", dealt=True)
    bare = F.regexp_replace("text", r"MySQL thread id \d+, OS thread handle \d+, query id (\d+) \S+ \S+ (\w+)", "query id $1 $2")
    rows = engine_status.parse_engine_status(samples.withColumn("text", bare), "full", missing="nobody")
    return rows.select("event_id", "type", "user", "host", "thread", "trx")


@query(
    "relations_in_report_order",
    """WITH r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'OUTBOUND' ELSE 'INBOUND' END AS direction,
            CASE user_id % 5 WHEN 0 THEN 'PHYSICAL_FK' WHEN 1 THEN 'COMPLETE_VIRTUAL_FK' WHEN 2 THEN 'PARTIAL_VIRTUAL_FK' WHEN 3 THEN 'AMBIGUOUS_VIRTUAL_FK' ELSE 'OTHER' END AS classification,
            CASE user_id % 5 WHEN 4 THEN 9 ELSE user_id % 5 + 1 END AS place, event_type AS source_table, event_id FROM events)
       SELECT direction, classification, source_table, event_id, lag(event_id) OVER (ORDER BY CASE direction WHEN 'OUTBOUND' THEN 1 ELSE 2 END, place, source_table, event_id) AS before_event_id FROM r""",
)
def relations_in_report_order(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in (*topology.CLASS_RANK, "OTHER")])
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 2 == 0, "OUTBOUND").otherwise("INBOUND").alias("direction"),
        F.get(kinds, (F.col("user_id") % 5).cast("int")).alias("classification"),
        F.lit("s").alias("server"), F.lit("d").alias("source_schema"), F.col("event_type").alias("source_table"),
        F.lit("").alias("constraint_name"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("source_columns"), "event_id",
    )
    out = _ordered_pairs(topology.order_relations(rows), "event_id", "direction", "classification", "source_table")
    return out.select("direction", "classification", "source_table", "event_id", "before_event_id")
