"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features and flattened into arrays; scoring walks all rows of a batch down all levels in
numpy. The model is fitted on SAMPLE_ROWS labelled rows at most (expected), outside of the held-out quarter.

Defined cases: null text counts as empty; empty texts are scored like others; rows without a label are scored; a doc_id with
several labels counts with the largest; without labels of both kinds all scores are their mean (0.5 without any); equal rows are
all kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch

SAMPLE_ROWS = 20_000
BINS, DEPTH, ROUNDS, RATE, L2, LEAST_ROWS = 64, 4, 60, 0.2, 1.0, 10
THRESHOLD = 0.7
FEATURES = (
    "log_chars", "log_words", "log_lines", "upper", "lower", "digit", "space", "period_comma", "exclaim", "pipe", "symbol", "other_punct", "non_ascii",
    "entropy", "word_mean", "word_std", "word_max", "short_words", "distinct_words", "top_word", "distinct_pairs", "repeats_in_row", "distinct_lines", "line_mean", "ends_punct", "plain_words", "long_words", "brackets",
)


def _class_table() -> np.ndarray:
    """Byte -> column of the class it counts for."""
    t = np.full(256, 9)
    for chars, k in ((range(65, 91), 0), (range(97, 123), 1), (range(48, 58), 2), (b" \t\n\r\v\f", 3), (b".,", 4), (b"!", 5), (b"|", 6), (b"#$%&*@~^_=+<>\\`", 7), (b"()[]{}", 10), (range(128, 256), 8)):
        t[list(chars)] = k
    return t


CLASSES = _class_table()


def statistics(text: str) -> list[float]:
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    share = np.bincount(CLASSES, weights=counts, minlength=11) / n
    p = counts[counts > 0] / n
    words = text.split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    kinds = Counter(words)
    lines = text.split("\n")
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), *share[[0, 1, 2, 3, 4, 5, 6, 7, 9, 8]], float(-(p * np.log2(p)).sum()),
        float(sizes.mean()), float(sizes.std()), float(sizes.max()), float((sizes <= 3).mean()), len(kinds) / m, max(kinds.values(), default=0) / m,
        len(set(zip(words, words[1:], strict=False))) / max(m - 1, 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, len(set(lines)) / len(lines), len(text) / len(lines),
        sum(w[-1] in ".,;:!?" for w in words) / m, sum(map(str.isalpha, words)) / m, float((sizes > 12).mean()), share[10],
    ]


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, features (array<float>) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, features array<float>")


class Trees:
    """Boosted trees as arrays: node i of a tree has the children 2i+1 and 2i+2; leaves stand at the last level."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.threshold, self.leaf = start, feature, threshold, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        if len(y) == 0 or y.min() == y.max():
            mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
            return cls(float(np.log(mean / (1 - mean))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
        n, k = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        start = float(np.log(y.mean() / (1 - y.mean())))
        raw = np.full(n, start)
        out_f, out_t, out_l = [], [], []
        slot = binned + np.arange(k) * BINS
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (k * BINS) + slot).ravel()
                hist = lambda v: np.bincount(at, np.repeat(v, k), width * k * BINS).reshape(width, k, BINS)  # noqa: B023, E731
                gs, hs, ns = (np.cumsum(hist(v), 2) for v in (g, h, np.ones(n)))
                gt, ht, nt = gs[..., -1:], hs[..., -1:], ns[..., -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < LEAST_ROWS) | (nt - ns < LEAST_ROWS)] = 0
                best = gain.reshape(width, -1).argmax(1)
                for i in range(width):
                    j, cut = divmod(int(best[i]), BINS)
                    if gain[i, j, cut] > 1e-9 and cut < len(edges[j]):
                        f[first + i], t[first + i] = j, edges[j][cut]
                node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
            at = node - inner
            leaf = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
            raw += leaf[at]
            out_f.append(f)
            out_t.append(t)
            out_l.append(leaf)
        return cls(start, np.array(out_f), np.array(out_t), np.array(out_l))

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            raw += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-raw))


def remainder(doc_id) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    known = Scratch(docs.sparkSession, "quality").cut(features(docs))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).where(remainder("doc_id") != 2)
    share = min(1.0, sample_rows / max(marks.count(), 1))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = known.join(drawn, "doc_id").select("features", "y").toPandas()  # sample_rows at most are expected
    x = np.array(rows["features"].tolist(), np.float32).reshape(-1, len(FEATURES))
    model = Trees.fit(x, rows["y"].to_numpy(float))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(np.asarray(b.column("features").flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = known.mapInArrow(work, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
