"""The operators are stateless for each document, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import tokens
from tokenloom.sources.vocabulary import Vocabulary


def token_rate(stream: DataFrame, v: Vocabulary, text_col: str, time_col: str, width: str, delay: str) -> DataFrame:
    """Tokens and rows in tumbling windows of event time; rows later than delay are left out."""
    counted = tokens.count(stream.select(time_col, text_col), v, text_col)
    w = F.window(time_col, width)
    return counted.withWatermark(time_col, delay).groupBy(w).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("n_tokens"))
