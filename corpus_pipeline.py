"""A corpus made ready for training: toxic documents out, repeated lines out, one of each group of near copies,
benchmark leaks out, and what remains packed into sequences.

Every stage takes all rows of the stage before and returns the columns of ``documents``, the last one pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import decontaminate, linededup, nearcopies, packing, toxicity
from opslens.llm.common import fresh, shared_folder, table
from opslens.llm.tokens import public_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = fresh(docs, "removed")
    out = linededup.without_repeated_lines(docs, removed_col=removed)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(out.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(removed)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_each_group(docs, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the fitted field nor the packing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
