"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared checkpoint folder and reads
them again for the next, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, near_dups, packing, pii, quality_knn
from tallyweave.llm.common import crc_mod, ensure_checkpoint_dir, free_name, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier scores under 0.3."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod(F.col("doc_id"), 5) != 0)
    model = quality_knn.train(docs.select("doc_id", "text"), labels)
    score = free_name("_score", docs.columns)
    return quality_knn.attach(docs, model, score=score).where(F.col(score) >= 0.3).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates."""
    return near_dups.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out, and drop documents that are little else."""
    return decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return pii.mask(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs, *packing.default_files())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packed)]
ORACLE_SQL = None  # the classifier and the token ids are beyond SQL; tests/llm holds it against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
