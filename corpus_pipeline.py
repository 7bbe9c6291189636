"""A training corpus from raw documents: five stages, each a table that the next one reads.

Documents of low quality go, then toxic ones; of near copies one stays; sources are mixed to their target shares, so
some documents go and some come twice; what is taken is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burdenflow.llm import mixing, near_copies, packing, quality, toxicity
from burdenflow.llm.store import keep
from burdenflow.llm.tokens import default_vocabulary


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.of_quality(docs, labels(spark, sf_dir))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.not_toxic(docs, labels(spark, sf_dir))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, default_vocabulary(), end=1)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near copies", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages learn, hash and decode; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep, each stage applied to the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
