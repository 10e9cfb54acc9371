"""Loading, deriving and checking vocabularies; files hold lines of ``base64 rank``."""

from __future__ import annotations

import base64
import binascii
import os
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.encodings import Encoding, encoding
from tokenloom.errors import TokenError, VocabularyError

#: File names under which a stem is known besides its own.
ALIASES = {"r50k_base": ("byte_bpe_50k.tiktoken",)}
FOLDERS = ("/opt/tokenizers",)


def parse_ranks(raw: bytes, where: str = "the vocabulary") -> dict[bytes, int]:
    """token -> rank, in order of rank. Blank lines are skipped; of equal tokens the lowest rank counts."""
    ranks: dict[int, bytes] = {}
    for n, line in enumerate(raw.splitlines(), 1):
        if not line.strip():
            continue
        fields = line.split()
        if len(fields) != 2:
            raise VocabularyError(f"{where}, line {n}: expected a token and a rank, found {len(fields)} fields")
        try:
            token = base64.b64decode(fields[0], validate=True)
        except binascii.Error as e:
            raise VocabularyError(f"{where}, line {n}: the token is not base64") from e
        digits = fields[1].lstrip(b"-")
        if not digits.isdigit():
            raise VocabularyError(f"{where}, line {n}: the rank {fields[1].decode(errors='replace')!r} is not a whole number")
        rank = int(fields[1])
        if rank < 0:
            raise VocabularyError(f"{where}, line {n}: the rank {rank} is negative")
        if rank in ranks:
            raise VocabularyError(f"{where}, line {n}: rank {rank} is there twice")
        ranks[rank] = token
    if not ranks:
        raise VocabularyError(f"{where} has no tokens")
    out: dict[bytes, int] = {}
    for rank in sorted(ranks):
        out.setdefault(ranks[rank], rank)
    return out


def with_space_runs(raw: bytes) -> bytes:
    """The larger 50k vocabulary: the smaller one and runs of 2 to 25 spaces from rank 50257 on."""
    lines = [base64.b64encode(b" " * n) + b" %d" % (50257 + n - 2) for n in range(2, 26)]
    return raw.rstrip(b"\n") + b"\n" + b"\n".join(lines) + b"\n"


def candidates(stem: str, explicit: str | None = None) -> list[str]:
    """Paths where a vocabulary is looked for: the explicit one alone, else a folder named in the environment, the cache, known
    folders and the working directory."""
    if explicit:
        return [explicit]
    env = os.environ.get("TOKENLOOM_VOCAB_DIR")
    cache = os.environ.get("XDG_CACHE_HOME") or str(Path.home() / ".cache")
    folders = [*([env] if env else []), f"{cache}/tokenloom", *FOLDERS, "."]
    return [f"{d}/{name}" for d in folders for name in (f"{stem}.tiktoken", *ALIASES.get(stem, ()))]


def read_vocabulary(stem: str, explicit: str | None = None) -> tuple[bytes, str]:
    tried = candidates(stem, explicit)
    for path in tried:
        if os.path.isfile(path):
            return Path(path).read_bytes(), path
    if stem == "p50k_base" and not explicit:
        raw, path = read_vocabulary("r50k_base")
        return with_space_runs(raw), path
    raise VocabularyError(f"no vocabulary file for {stem}; looked at {', '.join(tried)}")


@dataclass(frozen=True)
class Vocabulary:
    """Merge tokens and special tokens of an encoding, checked against each other."""

    encoding: Encoding
    ranks: dict[bytes, int]

    def __post_init__(self):
        assigned = set(self.ranks.values())
        special = {i for _, i in self.encoding.specials}
        if clash := assigned & special:
            raise VocabularyError(f"special token id {min(clash)} is a merge token's, too")
        if gaps := set(range(max(assigned))) - assigned - special:
            raise VocabularyError(f"rank {min(gaps)} is neither a token's nor a special token's")
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise VocabularyError(f"byte {missing[0]} has no token of its own")

    @classmethod
    def load(cls, name: str, path: str | None = None) -> Vocabulary:
        e = encoding(name)
        raw, where = read_vocabulary(e.vocabulary, path)
        return cls(e, parse_ranks(raw, where))

    @property
    def merge_count(self) -> int:
        """One past the highest merge id, holes included."""
        return max(self.ranks.values()) + 1

    @property
    def n_vocab(self) -> int:
        return max([self.merge_count - 1, *(i for _, i in self.encoding.specials)]) + 1

    @cached_property
    def token_bytes(self) -> dict[int, bytes]:
        return {i: n.encode() for i, n in self.encoding.special_names().items()} | {i: t for t, i in self.ranks.items()}

    def check_id(self, i: int) -> None:
        if not 0 <= i < self.n_vocab:
            raise TokenError(f"token id {i} is outside of 0..{self.n_vocab - 1} of {self.encoding.name}")
        if i not in self.token_bytes:
            raise TokenError(f"token id {i} of {self.encoding.name} is not assigned")


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """id, token of a vocabulary file, with the same checks as parse_ranks, as a DataFrame from any path that Spark reads."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.size(parts).alias("fields"), F.expr("try_to_binary(split(trim(value), '\\\\s+')[0], 'base64')").alias("token"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) AS int)").alias("id"))
    checks = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("fields") != 2).alias("fields"), F.count_if(F.col("token").isNull()).alias("token"),
        F.count_if(F.col("id").isNull()).alias("rank"), F.count_if(F.col("id") < 0).alias("negative"), F.countDistinct("id").alias("ids"),
    ).first()
    for bad, text in ((checks.n == 0, "has no tokens"), (checks.fields, "has lines without a token and a rank"), (checks.token, "has tokens that are not base64"), (checks["rank"], "has ranks that are not whole numbers"), (checks.negative, "has negative ranks"), (checks.ids != checks.n, "has a rank twice")):
        if bad:
            raise VocabularyError(f"{path} {text}")
    return rows.select("id", "token")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, content of raw files, whole and byte for byte."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
