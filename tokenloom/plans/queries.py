"""A query for each operator over the driver's tables; their SQL is in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.encodings import ENCODINGS, encoding
from tokenloom.operators import text as T
from tokenloom.operators import tokens
from tokenloom.plans.tokenizer import Tokenizer
from tokenloom.sources.vocabulary import Vocabulary


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def tokens_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: token totals by language and source."""
    d = Tokenizer.load(spark, "gpt2").count_ordinary(docs(spark, sf_dir, "lang", "source"))
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _pretokenize(pattern: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = tokens.spread(docs(spark, sf_dir)).withColumn("p", T.pieces(F.col("text"), pattern))
        size = F.transform("p", lambda x: F.octet_length(x).cast("long"))
        return d.select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.md5(F.array_join("p", "\u0001")).alias("pieces_md5"), F.aggregate(size, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_bytes"))

    return query


def piece_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.piece_ends(docs(spark, sf_dir), "gpt2")
    return d.select("doc_id", F.col("piece_ix").cast("long").alias("piece_ix"), F.col("end").alias("end_byte"))


def piece_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.piece_frequency(docs(spark, sf_dir), "gpt2")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a special token in every third one, by concatenation."""
    return docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("<|endoftext|>"), F.substring("text", 1, 20))).otherwise(F.col("text")))


def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.segment_rows(_marked(spark, sf_dir), encoding("gpt2"), ["<|endoftext|>"])
    return rows.select("doc_id", F.col("seg_ix").cast("long").alias("seg_ix"), F.md5("segment").alias("segment_md5"), F.col("special_id").cast("long").alias("special_id"))


def has_disallowed_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", T.has_disallowed(F.col("text"), encoding("gpt2")).alias("disallowed"))


def _count(name: str):
    return lambda spark, sf_dir: Tokenizer.load(spark, name).count_ordinary(docs(spark, sf_dir)).select("doc_id", "n_tokens")


def count_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tokenizer.load(spark, "gpt2").count(_marked(spark, sf_dir), allowed=["<|endoftext|>"]).select("doc_id", "n_tokens")


def encode_ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tokenizer.load(spark, "gpt2").encode_ordinary(docs(spark, sf_dir))
    return d.select("doc_id", tokens.format_ids(F.col("ids")).alias("ids"), "n_tokens")


def encode_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tokenizer.load(spark, "gpt2").encode(_marked(spark, sf_dir), allowed=["<|endoftext|>"])
    return d.select("doc_id", tokens.format_ids(F.col("ids")).alias("ids"))


def encode_onto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each text behind those of the special token."""
    d = docs(spark, sf_dir).withColumn("before", F.array(F.lit(50256)))
    return Tokenizer.load(spark, "gpt2").encode_onto(d, "before").select("doc_id", tokens.format_ids(F.col("before")).alias("ids"))


def flat_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.flat_ids(Tokenizer.load(spark, "gpt2").encode_ordinary(docs(spark, sf_dir)).select("doc_id", "ids", "n_tokens"))


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tokenizer.load(spark, "gpt2")
    d = t.decode(t.encode_ordinary(docs(spark, sf_dir)).select("doc_id", "ids"))
    return d.select("doc_id", "text", F.md5(tokens.format_ids(F.col("ids"))).alias("ids_md5"))


def token_id_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = docs(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).distinct()
    return tokens.token_id_of(words, Vocabulary.load("gpt2"), "word").select("word", "id")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tokens.token_bytes(spark.range(50300).select(F.col("id").cast("int").alias("token_id")), Vocabulary.load("p50k_edit"), "token_id")
    return d.select("token_id", F.hex("token").alias("token"), "length", "assigned")


def fits_ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tokenizer.load(spark, "gpt2").fits(docs(spark, sf_dir), 512).select("doc_id", "fits")


def truncate_ordinary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tokenizer.load(spark, "gpt2").truncate(docs(spark, sf_dir), 512).select("doc_id", "cut")


def _windows(most: int, overlap: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Tokenizer.load(spark, "gpt2").windows(docs(spark, sf_dir), most, overlap)
        return d.select("doc_id", F.posexplode("windows").alias("ix", "w")).select("doc_id", "ix", "w.*", tokens.window_text(F.col("w")).alias("shown"))

    return query


def batch_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.batch_offsets(Tokenizer.load(spark, "gpt2").count_ordinary(docs(spark, sf_dir)))


def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 doc_ids, cut to 256 tokens, each padded to its own longest."""
    d = docs(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 64))
    d = Tokenizer.load(spark, "gpt2").pad(d, 50256, 256, batch="batch")
    return d.select("doc_id", "batch", tokens.format_ids(F.col("ids")).alias("ids"), F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"), "length", "width")


def pad_mask_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one batch."""
    d = Tokenizer.load(spark, "gpt2").pad(docs(spark, sf_dir), 50256)
    return d.agg(F.count(F.lit(1)).alias("rows"), F.max("width").alias("width"), F.sum("length").alias("real"), F.sum(F.col("width") - F.col("length")).alias("padding"))


def padded_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id and mask in places 0 and 255 of each row cut or padded to 256 tokens."""
    d = Tokenizer.load(spark, "gpt2").pad(docs(spark, sf_dir).withColumn("text", F.concat("text", F.repeat(F.lit(" a"), 256))), 50256, 256)
    return d.select("doc_id", *(tokens.at(F.col(c), i).cast("int").alias(f"{c}_{i}") for c in ("ids", "mask") for i in (0, 255)))


def vocab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("gpt2", "r50k_base", "p50k_base", "p50k_edit"):
        one = tokens.describe(spark, Vocabulary.load(name))
        out = one if out is None else out.unionByName(one)
    return out


def special_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e.name, n, name, i) for e in ENCODINGS.values() for n, (name, i) in enumerate(e.specials)]
    d = spark.createDataFrame(rows, "encoding string, ord long, name string, id long")
    return d.groupBy("encoding").agg(F.count(F.lit(1)).alias("names"), F.countDistinct("id").alias("ids"), F.max("id").alias("highest"), F.min_by("name", "ord").alias("first_name"))


def vocab_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tokens.vocabulary_diff(spark, Vocabulary.load("r50k_base"), Vocabulary.load("p50k_base"))
    return d.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.cache_statistics(docs(spark, sf_dir), "gpt2")


def format_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tokenizer.load(spark, "gpt2").encode_ordinary(docs(spark, sf_dir))
    return d.select("doc_id", *(tokens.format_ids(F.col("ids"), k).alias(k) for k in ("space", "lines", "json")))


def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("[1,-5;"), F.col("n_chars").cast("string"), F.lit("]"))
    return docs(spark, sf_dir, "n_chars").select("doc_id", F.array_join(tokens.parse_ids(text).cast("array<string>"), ",").alias("ids"))


def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tokenizer.load(spark, "gpt2").truncate(docs(spark, sf_dir), 512)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select("doc_id", total.alias("total"), (total <= 512).alias("fits"), F.greatest(F.lit(0), total - 512).alias("overflow"), "cut")


def chunk_and_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each document as texts of their own, encoded and padded: real and padding tokens by document."""
    t = Tokenizer.load(spark, "gpt2")
    d = t.windows(docs(spark, sf_dir), 256, 32).select("doc_id", F.encode("text", "UTF-8").alias("raw"), F.posexplode("windows").alias("ix", "w"))
    parts = d.select("doc_id", "ix", F.decode(F.substring("raw", (F.col("w.start") + 1).cast("int"), (F.col("w.end") - F.col("w.start")).cast("int")), "UTF-8").alias("text"))
    padded = t.pad(parts, 50256)
    return padded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("real"), F.sum(F.col("width") - F.col("length")).alias("padding"))


def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tokens.estimated_tokens(F.col("text")).alias("estimate"))


QUERIES = {
    "tokens_by_lang_source": tokens_by_lang_source,
    **{f"pretokenize_{p}": _pretokenize(p) for p in ("gpt2", "cl100k", "o200k")},
    "piece_ends": piece_ends, "piece_frequency": piece_frequency, "segment_split": segment_split, "has_disallowed_special": has_disallowed_special,
    **{f"count_ordinary_{n}": _count(n) for n in ("gpt2", "r50k_base", "p50k_base", "p50k_edit")},
    "count_special": count_special, "encode_ordinary": encode_ordinary, "encode_allowed": encode_allowed, "decode_roundtrip": decode_roundtrip, "token_id_of": token_id_of, "token_bytes": token_bytes,
    "fits_ordinary": fits_ordinary, "truncate_ordinary": truncate_ordinary, "windows": _windows(256, 0), "windows_overlap": _windows(256, 32), "batch_offsets": batch_offsets, "pad_batch": pad_batch,
    "pad_mask_totals": pad_mask_totals, "padded_at": padded_at, "encode_onto": encode_onto, "flat_batch": flat_batch, "vocab_summary": vocab_summary, "special_registry": special_registry, "vocab_diff": vocab_diff, "cache_stats": cache_stats, "format_json": format_json, "parse_ids": parse_ids,
    "budget_report": budget_report, "chunk_and_pad": chunk_and_pad, "estimated_tokens": estimated_tokens,
}
