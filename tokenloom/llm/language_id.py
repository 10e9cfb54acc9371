"""Language identification by Bayesian fusion of evidence.

log P(language | evidence) = log P(text | language), tempered, + log P(declared language | language)
+ log P(address suffix | language) + log P(language | host), normalised over the languages.

Text: a naive Bayes model over hashed byte trigrams of the lower-cased text, counted on a bounded sample of labelled rows
(SAMPLE_ROWS expected). Host priors: the text's posteriors summed by host, smoothed towards the host's domain, which is smoothed
towards all. A text is rejected (language "und") if it has no letters, if it has FLAT_TRIGRAMS trigrams or more and a model in which
every bucket is as likely explains it better than every language, or if the best posterior stays below LEAST_POSTERIOR.

Defined cases: null or empty text is rejected; null host, address or declaration says nothing; equal rows are all kept; of languages
that are equally likely the first by name counts; texts of any length are read whole; an empty table gives an empty result; other
columns are kept whatever their names, columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import caches
from tokenloom.llm.scratch import Scratch

BUCKETS = 1 << 14
SAMPLE_ROWS = 20_000
TEXT_WEIGHT, MOST_TRIGRAMS = 0.25, 400.0
HOST_STRENGTH, DOMAIN_STRENGTH = 20.0, 50.0
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.9
LEAST_POSTERIOR = 0.5
FLAT_TRIGRAMS = 200  #: shorter texts are too short to be held against the flat model
#: Country suffixes of addresses and the language that they suggest.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}
UNDETERMINED = "und"


def trigram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, index of its text); texts are parted by NUL bytes, so no trigram spans two of them."""
    joined = b"\0\0".join(texts).lower()
    b = np.frombuffer(joined, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    ends = np.cumsum([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: len(code)]
    inside = (b[:-2] != 0) & (b[1:-1] != 0) & (b[2:] != 0)
    return ((code * np.uint32(2654435761)) >> np.uint32(18))[inside], owner[inside]


def _groups(column: pa.Array, most: int = 250_000) -> Iterator[tuple[int, list[bytes]]]:
    start, some, size = 0, [], 0
    for i in range(len(column)):
        text = (column[i].as_py() or "").encode()
        if some and size + len(text) > most:
            yield start, some
            start, some, size = i, [], 0
        some.append(text)
        size += len(text)
    if some:
        yield start, some


class TextModel:
    """languages, and log P(bucket | language) as one array."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p

    @classmethod
    def fit(cls, docs: DataFrame, label_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> TextModel:
        n = docs.count()
        share = min(1.0, sample_rows / max(n, 1))
        d = docs.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
        drawn = F.pmod(F.xxhash64("row", "text"), F.lit(1 << 20)) < int(share * (1 << 20))  # by row, so copies of a text aren't drawn together
        sample = d.where(F.col("label").isNotNull() & F.col("text").isNotNull() & drawn).select("label", "text")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            caches.enter("language", lambda: None)
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                labels = b.column("label").to_pylist()
                for start, texts in _groups(b.column("text")):
                    bucket, owner = trigram_buckets(texts)
                    of = np.array(labels[start : start + len(texts)], object)
                    for lang in set(of):
                        sums[lang] = sums.get(lang, 0) + np.bincount(bucket[(of == lang)[owner]], minlength=BUCKETS)
            for lang, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["label", "bucket", "n"])

        rows = sample.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
        languages = sorted({r.label for r in rows}) or [UNDETERMINED]
        counts = np.zeros((len(languages), BUCKETS))
        for r in rows:
            counts[languages.index(r.label), r.bucket] = r.n
        smooth = counts + 0.1 + counts.sum(1, keepdims=True) * 1e-6
        return cls(languages, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-likelihood of a trigram for each text and language, number of trigrams)."""
        bucket, owner = trigram_buckets(texts)
        n = np.bincount(owner, minlength=len(texts))
        sums = np.stack([np.bincount(owner, weights=row[bucket], minlength=len(texts)) for row in self.log_p], 1)
        return sums / np.maximum(n, 1)[:, None], n


def text_evidence(docs: DataFrame, model: TextModel, text_col: str, into: str, carried: list[str]) -> DataFrame:
    """The carried columns and ``into``, a struct, with logs (array<double>, by language, tempered) and explained (letters, and no long
    text that fits no language) added to it."""
    flat = -np.log(BUCKETS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("language", lambda: None)
        for b in batches:
            for start, texts in _groups(b.column(text_col)):
                part = b.select([*carried, into]).slice(start, len(texts))
                mean, n = model.score(texts)
                logs = mean * (TEXT_WEIGHT * np.minimum(n, MOST_TRIGRAMS))[:, None]
                ok = np.array([any(map(str.isalpha, t.decode())) for t in texts], bool) & ((mean.max(1) > flat) | (n < FLAT_TRIGRAMS))
                found = pa.StructArray.from_arrays([*part.column(into).flatten(), pa.array(list(logs), pa.list_(pa.float64())), pa.array(ok)], [*(f.name for f in part.column(into).type), "logs", "explained"])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], [*carried, into])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carried).schema.fields)
    said = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in docs.schema[into].dataType.fields)
    needed = list(dict.fromkeys([*carried, text_col, into]))
    return docs.select(*needed).mapInArrow(work, f"{kinds}`{into}` struct<{said}, logs: array<double>, explained: boolean>")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def host_priors(judged: DataFrame, n: int) -> DataFrame:
    """host, domain, host_logs from host, domain, p, explained: sums of the texts' posteriors by host and domain, smoothed
    host -> domain -> all."""
    sums = [F.sum(F.when(F.col("explained"), F.col("p")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(n)]
    hosts = judged.groupBy("host", "domain").agg(*sums)
    up = lambda by: hosts.groupBy(*by).agg(*(F.sum(f"s{i}").alias(f"{'_'.join(by) or 'all'}{i}") for i in range(n)))
    d = hosts.join(up(["domain"]), "domain").crossJoin(F.broadcast(up([])))  # the totals: one row
    plus = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    every, dom, host = ([f"{k}{i}" for i in range(n)] for k in ("all", "domain", "s"))
    base = [(F.col(c) + 1.0) / (plus(every) + float(n)) for c in every]
    mid = [(F.col(c) + DOMAIN_STRENGTH * b) / (plus(dom) + DOMAIN_STRENGTH) for c, b in zip(dom, base, strict=True)]
    low = [(F.col(c) + HOST_STRENGTH * b) / (plus(host) + HOST_STRENGTH) for c, b in zip(host, mid, strict=True)]
    return d.select("host", "domain", F.array(*(F.log(x) for x in low)).alias("host_logs"))


ADDED = ("language", "posterior", "text_language", "rejected")


def identify(
    docs: DataFrame, model: TextModel, text: str = "text", host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, declared: Column | None = None,
    carried: list[str] | None = None,
) -> DataFrame:
    """The carried columns (by default all of docs) with language, posterior, text_language and rejected in place of any of these names."""
    names, n = [c for c in (docs.columns if carried is None else carried) if c.lower() not in ADDED], len(model.languages)
    own = "_evidence"  # the only name beside those of docs: longer than any of them that begins like it
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    said = [(F.coalesce(x, F.lit("")) if x is not None else F.lit("")).alias(k) for k, x in (("host", host), ("domain", domain))]
    said += [(x if x is not None else F.lit(None).cast("string")).alias(k) for k, x in (("suffix", suffix), ("declared", declared))]
    d = text_evidence(docs.withColumn(own, F.struct(*said)), model, text, own, names)
    e = F.col(own)
    scratch = Scratch(docs.sparkSession, "language")
    judged = scratch.cut(d.withColumn(own, e.withField("p", _softmax(e["logs"]))))
    # Written, so that few hosts are seen to be few and texts stay where they are.
    priors = scratch.cut(host_priors(judged.select(f"{own}.*"), n)).select(*(F.col(c).alias(f"{own}_{c}") for c in ("host", "domain", "host_logs")))
    j = judged.join(priors, (e["host"] == F.col(f"{own}_host")) & (e["domain"] == F.col(f"{own}_domain")), "left")
    known = F.array(*map(F.lit, model.languages))
    hints = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))

    def hint(value: Column, right: float) -> Column:
        given = value.isNotNull() & F.array_contains(known, value)
        wrong = (1.0 - right) / max(n - 1, 1)
        return F.transform(known, lambda x: F.when(given & (x == value), F.log(F.lit(right))).when(given, F.log(F.lit(wrong))).otherwise(F.lit(0.0)))

    logs = e["logs"]
    for more in (F.col(f"{own}_host_logs"), hint(F.lower(F.substring(e["declared"], 1, 2)), DECLARED_RIGHT), hint(hints[e["suffix"]], SUFFIX_RIGHT)):
        logs = _add(logs, more)
    best = lambda p: known[F.array_position(p, F.array_max(p)).cast("int") - 1]  # noqa: E731  the first of equals
    j = j.select(*names, F.struct(_softmax(logs).alias("fused"), e["p"].alias("p"), e["explained"].alias("explained")).alias(own))
    j = j.select(*names, F.struct(F.col(f"{own}.*"), F.array_max(f"{own}.fused").alias("posterior")).alias(own))
    rejected = ~e["explained"] | (e["posterior"] < LEAST_POSTERIOR)
    return j.select(*names, F.when(rejected, UNDETERMINED).otherwise(best(e["fused"])).alias("language"), e["posterior"].alias("posterior"), best(e["p"]).alias("text_language"), rejected.alias("rejected"))


def identify_documents(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """documents: the source stands for the host; a declaration in the text's own markup counts, the label column does not."""
    model = TextModel.fit(docs)
    return identify(docs, model, "text", host=F.col("source"), carried=carried, declared=F.nullif(F.regexp_extract("text", r"<html[^>]{0,200}\blang=[\"']?([A-Za-z]{2})", 1), F.lit("")))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """pages: host, domain and suffix from the address, the declared language from the markup, the text without tags."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1))
    plain = "_plain"
    while plain in map(str.lower, pages.columns):
        plain += "_"
    bare = pages.withColumn(plain, F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "))
    return identify(
        bare, model, plain, host=host, domain=F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), suffix=F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit("")),
        declared=F.nullif(F.regexp_extract("html", r"<html[^>]{0,200}\blang=[\"']?([A-Za-z]{2})", 1), F.lit("")), carried=pages.columns,
    )
