"""Queries of operators that learn or count over the corpus: quality, language, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import fingerprints, language_id, quality
from tokenloom.llm.queries_basic import table


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "language", "posterior", "text_language", "rejected")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.TextModel.fit(table(spark, sf_dir, "documents"))
    return language_id.identify_pages(table(spark, sf_dir, "pages"), model).select("page_id", "language", "posterior", "text_language", "rejected")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
