"""From raw documents to packed sequences: quality, exact and near copies, mix, packing.

Every stage takes (spark, docs, sf_dir), works on all rows the one before kept, and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes each stage's rows
and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefixlake.llm import importance, mixing, packing, refine, weighted_minhash
from prefixlake.llm.queries import vocabulary_path
from prefixlake.session import materialize, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship_package(spark)
    return importance.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return refine.without_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    ship_package(spark)
    return weighted_minhash.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document may come several times."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document in sequences of at most a window."""
    ship_package(spark)
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None  # the learned rules, near copies and token ids are not SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
