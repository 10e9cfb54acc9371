"""Queries of operators on pairs: near-duplicate texts and embeddings, repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import embeddings, minhash, suffix_dedup
from tokenloom.llm.queries_basic import table


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as this query's contract has it; the operator's own default is five words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_digests(table(spark, sf_dir, "documents"))
