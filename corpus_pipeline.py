"""A corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import copies, decontaminate, hilbert, mixture, toxicity
from folio.llm.common import stage
from folio.session import ship_package

SHARDS = 24


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    ship_package(spark)
    return toxicity.civil_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship_package(spark)
    return copies.one_per_component(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship_package(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    ship_package(spark)
    return mixture.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of them in shards along the curve."""
    ship_package(spark)
    return hilbert.clustered(docs, SHARDS)


STAGES = [("toxicity", civil), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("mixture", mixed), ("shards", sharded)]
# Learned scores and components of near texts are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stage(docs)
    return docs
