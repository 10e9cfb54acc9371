"""Special tokens and pre-tokenization as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.encodings import Encoding
from tokenloom.errors import SpecialTokenError
from tokenloom.functions.patterns import PATTERNS, java_pattern, split


def needs_python(text: Column) -> Column:
    """The text has a code point that the JVM's Unicode tables don't know."""
    return text.rlike(r"[^\x00-\x7F]") & text.rlike(r"\p{Cn}")


def _slow_pieces(pattern: str):
    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split(t, pattern))

    return pieces


def pieces(text: Column, pattern: str) -> Column:
    """The pieces of a text, which tile it; null for null. Java's regex does it, Python only for texts that Java misreads."""
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {pattern!r}")
    fast = F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))
    slow = _slow_pieces(pattern)(F.when(needs_python(text), text))
    return F.coalesce(slow, fast)


def piece_ends(df: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece_ix, end: exclusive ends of the pieces in UTF-8 bytes; the sums run within a text."""
    d = df.select(id_col, F.posexplode(pieces(F.col(text_col), pattern)).alias("piece_ix", "piece"))
    w = Window.partitionBy(id_col).orderBy("piece_ix").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(id_col, "piece_ix", F.sum(F.octet_length("piece")).over(w).alias("end"))


def quoted(names: Iterable[str]) -> str:
    """A regex for any of the names, for Java and Python alike; of names that match at one place, the first one listed counts."""
    return "|".join(re.sub(r"([^\w])", r"\\\1", n) for n in names)


def policy(enc: Encoding, allowed: Iterable[str]) -> tuple[list[str], list[str]]:
    """(allowed, disallowed) names in the encoding's order."""
    known, allowed = [n for n, _ in enc.specials], set(allowed)
    if unknown := sorted(allowed - set(known)):
        raise SpecialTokenError(f"{enc.name} has no special token {unknown[0]!r}")
    return [n for n in known if n in allowed], [n for n in known if n not in allowed]


def has_disallowed(text: Column, enc: Encoding, allowed: Iterable[str] = ()) -> Column:
    _, refused = policy(enc, allowed)
    return text.rlike(quoted(refused)) if refused else F.lit(False)


def checked(text: Column, enc: Encoding, allowed: Iterable[str] = ()) -> Column:
    """The text; fails on rows that hold a special token which isn't allowed."""
    _, refused = policy(enc, allowed)
    if not refused:
        return text
    found = F.regexp_extract(text, quoted(refused), 0)
    return F.when(text.rlike(quoted(refused)), F.raise_error(F.concat(F.lit("the text holds the special token "), found, F.lit(", which is not allowed")))).otherwise(text)


def segments(text: Column, names: list[str]) -> Column:
    """The text cut into special tokens and what stands between them, in order."""
    if not names:
        return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    any_of = quoted(names)
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{any_of})|(?:(?!{any_of}).)+"), F.lit(0))


def segment_rows(df: DataFrame, enc: Encoding, allowed: Iterable[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, seg_ix, segment, special_id (null for text)."""
    names, _ = policy(enc, allowed)
    ids = F.create_map(*(F.lit(x) for n, i in enc.specials if n in set(names) for x in (n, i))) if names else None
    rows = df.select(id_col, F.posexplode(segments(checked(F.col(text_col), enc, allowed), names)).alias("seg_ix", "segment"))
    return rows.withColumn("special_id", ids[F.col("segment")] if names else F.lit(None).cast("int"))


def python_segments(text: str, names: list[str], ids: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    if not names:
        yield text, None
        return
    for part in re.split(f"({quoted(names)})", text):
        if part:
            yield part, ids.get(part)
