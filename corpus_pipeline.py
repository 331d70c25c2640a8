"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; stages are written as Parquet and read again in between. All but the last return the
columns of documents: quality rules drop rejected documents, near-dedup keeps one document of each
group, decontamination drops documents that carry a benchmark item, personal data are replaced in
the text (n_chars follows), and mixing adds mix_rate and mix_copies and drops documents without a copy.

Defined results: a null or empty text fails the quality rules. Rows that repeat a doc_id stay or go together in near-dedup and
decontamination, where decisions are by id; quality rules and mixing decide by row. A null doc_id is kept by near-dedup unless another row has its
text, and by decontamination. Empty tables give empty results; texts of any length are read whole; further columns pass through all stages
(mix_rate and mix_copies are replaced by the last).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.llm import decontaminate, mixing, near_dedup, pii, quality_rules
from cartograph.session import cut, shared_dir

#: Ids broadcast to drop documents; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those whose doc_id is in ``ids`` (doc_id)."""
    ids = cut(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, near_dedup.near_duplicates(docs).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixture),
]

#: The classifier of the last stage can't be put in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
