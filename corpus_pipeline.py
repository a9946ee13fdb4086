"""A corpus pipeline: each stage reads what the one before it kept.

The benchmark and label tables are read beside the documents where a stage needs them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm.common import documents, fresh, table
from weftline.llm.mixing import mixed
from weftline.llm.near_copies import one_of_each
from weftline.llm.resampling import resample
from weftline.llm.sharding import SHARDS, shard_of
from weftline.llm.wu_manber import clean
from weftline.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return resample(spark, docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays.

    SimHash fingerprints of five-word shingles give the first links, min-hash bands those farther apart; all are verified at similarity 0.8 or more.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard, and the one it would have with one shard more."""
    shard, grown = fresh(docs, "shard"), fresh(docs, "grown_shard")
    return docs.withColumn(shard, shard_of(F.col("doc_id"))).withColumn(grown, shard_of(F.col("doc_id"), SHARDS + 1))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_target_weights", mixing),
    ("sharding", sharding),
]

#: Neither trained weights nor min-hashes can be said in SQL; tests/llm compares the near-copy stage with all pairs, the others by their properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the checkpoint folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/weftline/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
