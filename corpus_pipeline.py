"""A corpus from documents: quality, toxicity, near duplicates, mix, packing. Each stage is one operator of gridwake.llm.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridwake import ship
from gridwake.llm import jaccard_join, mixing, packing, quality, toxicity
from gridwake.llm.common import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject."""
    ship.to_executors(spark)
    return quality.keep_good(docs, _labels(spark, sf_dir))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    ship.to_executors(spark)
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ship.to_executors(spark)
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.mixed(docs, _labels(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 2048 tokens. Executors that ran the other stages have little memory left, so the tokenizer is small."""
    ship.to_executors(spark)
    return packing.pack(docs, VOCABULARY, keep_ids=False, small=True)


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", distinct), ("mixing", mix), ("packing", pack)]
#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each to what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
