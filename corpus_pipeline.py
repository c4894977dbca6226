"""A corpus from raw documents to shards: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, mixing, quality, sharding, simhash
from tallyforge.llm.common import shielded, table, written

LEAST_QUALITY = 0.3
N_SHARDS = 40


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    inner, back = shielded(docs, "doc_id", "text")
    return back(quality.quality_scores(inner, model, inner.columns).where(F.col("__score") >= LEAST_QUALITY))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one with the smallest id."""
    return simhash.simhash_dedup(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it: not at all, once or twice."""
    return mixing.mix(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it; shards are even in bytes."""
    return sharding.shard(docs, n_shards=N_SHARDS)


STAGES = [
    ("quality_classifier", good_documents),
    ("simhash_dedup", distinct_documents),
    ("decontaminate", clean_documents),
    ("mix_sources", mixed_documents),
    ("shard", sharded_documents),
]

# the classifier and the packing cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
