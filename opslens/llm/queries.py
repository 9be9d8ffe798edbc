"""One registered query per operator, over its whole table, and the SQL twins where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import balltree, chat, collocations, decontaminate, linededup, packing, repair, simhash, spelling, suffixes, toxicity, urls, windows
from opslens.llm.common import shared_folder, table
from opslens.llm.tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents")).drop("component_fingerprint")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.without_repeated_lines(table(spark, sf_dir, "documents"), removed_col="n_removed")
    return out.select("doc_id", "text", "n_removed")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return balltree.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


SQL["op5_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


SQL["op4_chat"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaks, coalesce(text, '') AS text FROM conversations
), s AS (SELECT DISTINCT conv_id AS c, speaks AS speaker FROM t WHERE speaks <> 'system'
), p AS (
  SELECT conv_id, speaker, turn, speaks, text,
    CASE WHEN speaks = speaker THEN 'assistant' WHEN speaks = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN speaks <> speaker AND speaks <> 'system' THEN speaks END AS name, speaks = speaker AS trained
  FROM t JOIN s ON conv_id IS NOT DISTINCT FROM c
), h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS header FROM p
), g AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS segment FROM h
), o AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) - length(segment) AS start FROM g
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, speaks, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, position, turn, role, name, segment, start, start + length(header) AS content_start,
  start + length(header) + length(text) AS content_end, trained
FROM o
"""

#: (verdict, host, path)
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the quality of the document of the same number, where that has one.

    About 85 in 100 labels are good, so a template is rejected below 70, not below one half.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    return urls.judge(table(spark, sf_dir, "pages"), labels, URL_RULES, least=0.7)


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/llm/token-files-{uuid.uuid4().hex}"
    repair.write_shards(table(spark, sf_dir, "documents"), path, public_path("word_bpe_49k.json"), end_id=2)
    return repair.read_documents(spark.read.parquet(path))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op11_collocations"] = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
), g AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), (SELECT unnest(range(1, 5)) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM g WHERE k > 1
), s AS (
  SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : cut], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1 :], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), x AS (
  SELECT lang, f, size, string_split(phrase, ' ') AS w, unnest(range(1, k - size + 2)) AS i
  FROM (SELECT *, unnest(range(2, k)) AS size FROM g WHERE k > 2)
), v AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(f) AS cover FROM x GROUP BY ALL
), z AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN v USING (lang, phrase) WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windows(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), noise=97))


# The crc table comes from its rule; pairs come from equal remains after one deletion.
SQL["op13_spelling"] = """
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS UBIGINT)], CAST(range(8) AS UBIGINT[])),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), d AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, hex(encode(id || ':' || w)) AS x, count(*) AS k
  FROM runs GROUP BY ALL HAVING length(w) >= 5
), h AS (
  SELECT w, k, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT],
      list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT))),
    lambda c, b: xor(c >> 8, crc[CAST(1 + xor(c, b) % 256 AS BIGINT)]))) AS h
  FROM d, t
), c AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM h
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS MATERIALIZED (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON rest = words.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM near GROUP BY word
), judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN form_n >= 2 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = form_n) END AS form,
    CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
), chain AS (
  SELECT word, word AS tail FROM judged
  UNION ALL SELECT chain.word, form FROM chain JOIN judged ON judged.word = chain.tail WHERE form IS NOT NULL
)
SELECT j.word, j.form, tail AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN chain ON chain.word = j.word JOIN judged e ON e.word = chain.tail AND e.form IS NULL
"""
