"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Language ID drops what has no language, near-dedup keeps one document of each group, secrets are replaced in the texts, sources are
mixed to their targets (a document comes once for each pass in which the mix takes words of it, with those words), and the texts are
encoded.

Defined cases, of every stage: rows with null or empty text have no language, so they go in the first one; a null doc_id or one that
several rows share is a row like others; very long texts are taken whole; repeated rows are near-duplicates, one stays; an empty
table gives empty results; further columns pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bpe_codec, language_id, minhash, mixing, secrets
from tokenloom.llm.queries_basic import BPE_FILE
from tokenloom.llm.scratch import BATCH, BATCH_ROWS, Scratch, collected

_made: list[Scratch] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after removing the intermediate tables of the one before: its result is written when the next one begins. Rows hold
    whole texts, so the session's Arrow batches are made small (BATCH_ROWS): a stage's last step runs when its result is written."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _made:
            if (old := _made.pop()).spark.sparkContext.applicationId == spark.sparkContext.applicationId:
                old.clear()
        if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
            spark.conf.set(BATCH, str(BATCH_ROWS))
        with collected() as made:
            out = work(spark, docs, sf_dir)
        _made.extend(made)
        return out

    stage.__doc__ = work.__doc__
    return stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with the language found as ``lang``; those without one go."""
    found = language_id.identify_documents(docs).where("not rejected")
    return found.withColumn("lang", F.col("language")).select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return minhash.representatives(docs)


@_stage
def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with [kind] in place of each secret."""
    return secrets.redact(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of the documents, in its order."""
    return mixing.mixed_documents(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and whether they decode to the text."""
    return bpe_codec.encoded(docs, BPE_FILE).select("doc_id", "lang", "source", "n_tokens", "token_ids", "round_trips")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", replace_secrets),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: Language model, near-duplicates and tokens cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = scratch.cut(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = done
    return docs
