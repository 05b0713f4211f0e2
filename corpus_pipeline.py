"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import decontamination, jaccard, mixing, sharding, toxicity
from quernel.llm.scratch import materialize

N_SHARDS = 40


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a field fitted on the labelled ones scores at 0.7 or more go."""
    crf = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, crf)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links join, the one with the least id stays."""
    return jaccard.deduplicate(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs, seed=1)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    return sharding.shard(docs, N_SHARDS, seed=7)


STAGES = [
    ("toxicity", remove_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", remove_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]

#: The fitted field of the first stage has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
