"""Tokenizer: an encoding's operators bound to a Spark session."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.encodings import ENCODINGS
from tokenloom.operators import text as T
from tokenloom.operators import tokens
from tokenloom.operators.kernel import Kernel
from tokenloom.sources.vocabulary import Vocabulary


class Tokenizer:
    def __init__(self, spark: SparkSession, vocabulary: Vocabulary):
        self.spark, self.vocabulary = spark, vocabulary

    @classmethod
    def load(cls, spark: SparkSession, name: str, path: str | None = None) -> Tokenizer:
        return cls(spark, Vocabulary.load(name, path))

    @property
    def encoding(self) -> str:
        return self.vocabulary.encoding.name

    @property
    def n_vocab(self) -> int:
        return self.vocabulary.n_vocab

    def encode_ordinary(self, df: DataFrame, col: str = "text") -> DataFrame:
        return tokens.encode(df, self.vocabulary, col)

    def encode(self, df: DataFrame, col: str = "text", allowed: Iterable[str] = ()) -> DataFrame:
        """Special tokens in allowed become their ids; a text with any other one fails."""
        return tokens.encode(df, self.vocabulary, col, allowed)

    def count_ordinary(self, df: DataFrame, col: str = "text") -> DataFrame:
        return tokens.count(df, self.vocabulary, col)

    def count(self, df: DataFrame, col: str = "text", allowed: Iterable[str] = ()) -> DataFrame:
        return tokens.count(df, self.vocabulary, col, allowed)

    def fits(self, df: DataFrame, most: int, col: str = "text") -> DataFrame:
        return tokens.fits_within(df, self.vocabulary, most, col)

    def truncate(self, df: DataFrame, budget: int, col: str = "text") -> DataFrame:
        d = tokens.piece_token_counts(df, self.vocabulary, col)
        return d.withColumn("cut", tokens.truncate_at(F.col("ends"), F.col("counts"), budget))

    def windows(self, df: DataFrame, most: int, overlap: int = 0, col: str = "text") -> DataFrame:
        return tokens.windows(df, self.vocabulary, most, overlap, col)

    def encode_onto(self, df: DataFrame, ids_col: str, col: str = "text", allowed: Iterable[str] | None = None) -> DataFrame:
        """The text's ids appended to ids_col; without a list of allowed names, special tokens are text."""
        return tokens.encode_onto(df, self.vocabulary, ids_col, col, allowed)

    def pad(self, df: DataFrame, pad_id: int, most: int = 0, col: str = "text", batch: str | None = None) -> DataFrame:
        return tokens.pad(self.encode_ordinary(df, col), self.vocabulary, pad_id, most, batch)

    def decode_bytes(self, df: DataFrame, col: str = "ids") -> DataFrame:
        return tokens.decode(df, self.vocabulary, col)

    def decode(self, df: DataFrame, col: str = "ids") -> DataFrame:
        return self.decode_bytes(df, col).withColumn("text", tokens.decoded_text(F.col("bytes")))

    def register(self, prefix: str | None = None) -> list[str]:
        """Makes <prefix>_count, <prefix>_encode and <prefix>_fits known to SQL, as Arrow-batched functions."""
        prefix, ranks, pattern = prefix or self.encoding, self.vocabulary.ranks, self.vocabulary.encoding.pattern
        kernel = Kernel(ranks, pattern)

        def found(texts: pd.Series):
            kernel.forget()
            return kernel.encode_texts(pa.array(texts.fillna("").tolist(), pa.string()))

        @F.pandas_udf("bigint")
        def count(texts: pd.Series) -> pd.Series:
            return pd.Series(found(texts).counts(), dtype="Int64").mask(texts.isna().to_numpy())

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            ids = found(texts)
            return pd.Series(np.split(ids.ids(), np.cumsum(ids.counts())[:-1]) if len(texts) else [], dtype=object).mask(texts.isna().to_numpy(), None)

        @F.pandas_udf("boolean")
        def fits(texts: pd.Series, most: pd.Series) -> pd.Series:
            return pd.Series(found(texts).counts() <= most.to_numpy(), dtype="boolean").mask((texts.isna() | most.isna()).to_numpy())

        for name, f in (("count", count), ("encode", encode), ("fits", fits)):
            self.spark.udf.register(f"{prefix}_{name}", f)
        return [f"{prefix}_{n}" for n in ("count", "encode", "fits")]

    def pieces(self, df: DataFrame, col: str = "text") -> DataFrame:
        return df.withColumn("pieces", T.pieces(F.col(col), self.vocabulary.encoding.pattern))

    def __repr__(self) -> str:
        return f"Tokenizer({self.encoding!r})"


def encoding_names() -> list[str]:
    return list(ENCODINGS)
