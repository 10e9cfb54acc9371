"""Encoding, counting, budgets, windows, batches, decoding and statistics on DataFrames.

Null text gives null; empty text gives no tokens. Text columns may be strings or binary; bytes that aren't UTF-8 are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.errors import SpecialTokenError, TokenError
from tokenloom.operators import text as T
from tokenloom.operators.batch import Ids, groups
from tokenloom.operators.kernel import MEMO_ENTRIES, Kernel, as_text, pack
from tokenloom.sources.vocabulary import Vocabulary

_kernels: dict[tuple, Kernel] = {}


def _kernel(ranks: dict[bytes, int], key: str, pattern: str, memo: int) -> Kernel:
    """One kernel, with its memo, for a worker and vocabulary."""
    if (key, pattern, memo) not in _kernels:
        _kernels[key, pattern, memo] = Kernel(ranks, pattern, memo)
    return _kernels[key, pattern, memo]


def _digest(v: Vocabulary) -> str:
    h = hashlib.sha256()
    for t, r in v.ranks.items():
        h.update(b"%d:%d:" % (r, len(t)) + t)
    return h.hexdigest()


#: Bytes of a row group: a table that has fewer of them than there are cores leaves cores idle.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it is so small that its row groups can't fill them; larger tables are read as they lie."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= n * ROW_GROUP:
        return df
    return df.repartition(n)


class Group:
    """Some texts of a batch: as strings (empty for null), and how those with special tokens or malformed bytes are encoded."""

    def __init__(self, kernel: Kernel, column: pa.Array, names: list[str], refused: list[str], ids: dict[str, int]):
        self.kernel, self.names, self.special = kernel, names, ids
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        self.odd: dict[int, str] = {}
        if pa.types.is_string(column.type):
            texts = column
        else:
            decoded: list[str | None] = []
            for i, raw in enumerate(column.to_pylist()):
                try:
                    decoded.append(None if raw is None else raw.decode())
                except UnicodeDecodeError:
                    self.odd[i] = as_text(raw)
                    decoded.append(None)
            texts = pa.array(decoded, pa.string())
            for t in (*decoded, *self.odd.values()) if refused else ():
                if t and (hit := re.search(T.quoted(refused), t)):
                    raise SpecialTokenError(f"the text holds the special token {hit[0]}, which is not allowed")
        self.texts = pc.fill_null(texts, "")
        self.apart = np.zeros(len(column), bool)
        for n in names:
            self.apart |= pc.match_substring(self.texts, n).to_numpy(zero_copy_only=False)
        self.apart[list(self.odd)] = True

    def text(self, i: int) -> str:
        return self.odd[i] if i in self.odd else self.texts[i].as_py()

    def _whole(self, i: int) -> bytes:
        cut = T.python_segments(self.text(i), self.names, self.special)
        return b"".join(self.kernel.encode(s) if k is None else int(k).to_bytes(4, "little") for s, k in cut)

    def ids(self) -> Ids:
        return self.kernel.encode_texts(self.texts, self._whole, self.apart)

    def piece_counts(self) -> list[tuple[list[int], list[int]] | None]:
        return [None if null else self.kernel.piece_counts(self.text(i)) for i, null in enumerate(self.null.tolist())]

    def counted(self, counts: np.ndarray) -> pa.Array:
        return pa.array(counts, pa.int64(), mask=self.null)


def _map(df: DataFrame, v: Vocabulary, text_col: str | Column, out: str, columns: Callable[[Group], list[pa.Array]], memo: int, allowed: Iterable[str] | None) -> DataFrame:
    """df with more columns from each text. allowed: None takes special tokens for text, a list refuses all others."""
    names, refused = ([], []) if allowed is None else T.policy(v.encoding, allowed)
    df = spread(df)
    ranks, key, pattern, ids = df.sparkSession.sparkContext.broadcast(v.ranks), _digest(v), v.encoding.pattern, v.encoding.special_ids()  # a vocabulary: of a fixed size
    new = [c.split()[0] for c in out.split(", ")]
    kept = [c for c in df.columns if c not in new]
    source = F.col(text_col) if isinstance(text_col, str) else text_col
    if dict(df.select(source.alias("t")).dtypes)["t"] == "string":
        source, refused = T.checked(source, v.encoding, allowed) if refused else source, []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = _kernel(ranks.value, key, pattern, memo)
        try:
            for b in batches:
                start = 0
                for part in groups(b.columns[-1]):
                    own = b.slice(start, len(part))
                    start += len(part)
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], *columns(Group(k, part, names, refused, ids))], [*own.schema.names[:-1], *new])
        finally:
            k.forget()

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema.fields)
    return df.select(*kept, source.alias("_text")).mapInArrow(work, kinds + out)


def _id_column(group: Group, found: Ids) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(found.counts())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ids(), pa.int32()), mask=pa.array(group.null))


def encode(df: DataFrame, v: Vocabulary, text_col: str = "text", allowed: Iterable[str] | None = None, memo: int = MEMO_ENTRIES) -> DataFrame:
    """df with ids (array<int>) and n_tokens."""

    def columns(g: Group) -> list[pa.Array]:
        found = g.ids()
        return [_id_column(g, found), g.counted(found.counts())]

    return _map(df, v, text_col, "ids array<int>, n_tokens long", columns, memo, allowed)


def encode_onto(df: DataFrame, v: Vocabulary, ids_col: str, text_col: str = "text", allowed: Iterable[str] | None = None) -> DataFrame:
    """df with the text's ids appended to those that already stand in ids_col; a null text or list adds nothing."""
    none = F.array().cast("array<int>")
    d = encode(df.withColumn("_before", F.coalesce(ids_col, none)), v, text_col, allowed)
    return d.withColumn(ids_col, F.concat("_before", F.coalesce("ids", none))).select(*df.columns)


def count(df: DataFrame, v: Vocabulary, text_col: str | Column = "text", allowed: Iterable[str] | None = None, memo: int = MEMO_ENTRIES) -> DataFrame:
    """df with n_tokens; the sizes of its words are added up, ids are not put together."""
    return _map(df, v, text_col, "n_tokens long", lambda g: [g.counted(g.ids().counts())], memo, allowed)


def piece_token_counts(df: DataFrame, v: Vocabulary, text_col: str = "text", memo: int = MEMO_ENTRIES) -> DataFrame:
    """df with ends (array<bigint>, bytes) and counts (array<int>) of the pieces."""

    def columns(g: Group) -> list[pa.Array]:
        both = g.piece_counts()
        return [pa.array([None if x is None else x[0] for x in both], pa.list_(pa.int64())), pa.array([None if x is None else x[1] for x in both], pa.list_(pa.int32()))]

    return _map(df, v, text_col, "ends array<bigint>, counts array<int>", columns, memo, None)


def fits_within(df: DataFrame, v: Vocabulary, most: int, text_col: str = "text") -> DataFrame:
    """df with fits: the text has ``most`` tokens or fewer. Only texts whose bytes leave that open are encoded: a token has one byte
    at least, and no more than the longest token."""
    size, longest = F.octet_length(text_col), max(map(len, v.ranks))
    sure = F.when((size == 0) | (size <= most), True).when(size > max(most, 0) * longest, False)
    d = df.withColumn("_sure", sure)
    counted = count(d, v, F.when(sure.isNull(), F.col(text_col)))
    return counted.withColumn("fits", F.coalesce("_sure", F.col("n_tokens") <= most)).drop("_sure", "n_tokens")


def fits(n_tokens: Column, most: int) -> Column:
    return n_tokens <= most


def estimated_tokens(text: Column) -> Column:
    """A cheap guess, from the bytes alone, of how much room the ids need."""
    return F.floor(F.octet_length(text) / 3).cast("long") + 16


def truncate_at(ends: Column, counts: Column, budget: int) -> Column:
    """The largest end of a piece up to which the tokens stay within the budget; 0 if there is none."""
    if budget < 0:
        raise ValueError("the budget must not be negative")
    s0 = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("cut"))
    step = lambda s, x: F.struct((s["sum"] + x["counts"]).alias("sum"), F.when(s["sum"] + x["counts"] <= budget, x["ends"]).otherwise(s["cut"]).alias("cut"))
    return F.aggregate(F.arrays_zip(ends.alias("ends"), counts.alias("counts")), s0, step)["cut"]


def windows(df: DataFrame, v: Vocabulary, most: int, overlap: int = 0, text_col: str = "text") -> DataFrame:
    """df with windows (array of start, end, tokens); see kernel.pack."""
    pack([], [], most, overlap)

    def columns(g: Group) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int32())]))
        found = [None if x is None else pack(*x, most, overlap) for x in g.piece_counts()]
        return [pa.array([None if w is None else [dict(zip(("start", "end", "tokens"), x, strict=True)) for x in w] for w in found], kind)]

    return _map(df, v, text_col, "windows array<struct<start:bigint,end:bigint,tokens:int>>", columns, MEMO_ENTRIES, None)


def window_text(window: Column) -> Column:
    return F.format_string("[%d, %d) %d tokens", window["start"], window["end"], window["tokens"])


def batch_offsets(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, end of each row in the flat buffer of all ids in the order of id.

    The running sum is taken within range partitions; only the partitions' totals meet.
    """
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = encoded.select(id_col, F.coalesce("n_tokens", F.lit(0)).alias("n")).repartitionByRange(n, id_col).withColumn("part", F.spark_partition_id())
    totals = d.groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    within = F.sum("n").over(Window.partitionBy("part").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("within", within).join(F.broadcast(before), "part")
    return d.select(id_col, (F.col("before") + F.col("within") - F.col("n")).alias("start"), (F.col("before") + F.col("within")).alias("end"))


def flat_ids(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """place, id: the flat buffer of all ids in the order of id_col, with the places that batch_offsets gives."""
    starts = batch_offsets(encoded, id_col).select(F.col(id_col).alias("_row"), "start")
    d = encoded.join(starts, F.col(id_col).eqNullSafe(F.col("_row")))
    return d.select("start", F.posexplode("ids").alias("at", "id")).select((F.col("start") + F.col("at")).alias("place"), "id")


def pad(encoded: DataFrame, v: Vocabulary, pad_id: int, most: int = 0, batch: str | None = None) -> DataFrame:
    """encoded with ids cut to ``most`` tokens (0: not) and padded to the longest of their batch, mask, length and width.

    ``batch`` names the column that tells batches apart; a batch is dealt to one task, and texts are encoded once. Without it the
    whole table is one batch, and the encoded rows are exchanged once for both its width and its rows. A null list stays null.
    """
    if not 0 <= pad_id < v.n_vocab:
        raise TokenError(f"pad id {pad_id} is outside of 0..{v.n_vocab - 1}")
    if most < 0:
        raise ValueError("the length must not be negative")
    cut = encoded.withColumn("ids", F.slice("ids", 1, most) if most else F.col("ids")).withColumn("length", F.size("ids"))
    longest = F.greatest(F.coalesce(F.max("length"), F.lit(0)), F.lit(0))
    if batch:
        d = cut.withColumn("width", F.greatest(F.coalesce(F.max("length").over(Window.partitionBy(batch)), F.lit(0)), F.lit(0)))
    else:
        cut = cut.repartition(int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        d = cut.crossJoin(F.broadcast(cut.agg(longest.alias("width"))))  # one row
    fill = F.col("width") - F.col("length")
    mask = F.concat(F.array_repeat(F.lit(1).cast("tinyint"), F.col("length")), F.array_repeat(F.lit(0).cast("tinyint"), fill))
    return d.withColumns({"mask": F.when(F.col("ids").isNotNull(), mask), "ids": F.concat("ids", F.array_repeat(F.lit(pad_id), fill))})


def at(values: Column, index: int) -> Column:
    """The value at a 0-based place; fails outside of the row."""
    return F.when((F.lit(index) < 0) | (F.lit(index) >= F.size(values)), F.raise_error(F.lit(f"place {index} is outside of the row"))).otherwise(F.get(values, F.lit(index)))


def decode(df: DataFrame, v: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """df with bytes: all tokens' bytes in order. Fails on an id that is outside of the id space or not assigned."""
    table, n, name = df.sparkSession.sparkContext.broadcast(v.token_bytes), v.n_vocab, v.encoding.name

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.__getitem__
        for b in batches:
            out = []
            for ids in b.column(ids_col).to_pylist():
                try:
                    out.append(None if ids is None else b"".join(map(get, ids)))
                except KeyError as e:
                    i = e.args[0]
                    raise TokenError(f"token id {i} of {name} is " + ("not assigned" if 0 <= i < n else f"outside of 0..{n - 1}")) from None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "bytes"])

    df = df.drop("bytes")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    return df.mapInArrow(work, f"{kinds}bytes binary")


def decoded_text(raw: Column) -> Column:
    """Bytes as text; fails if they aren't UTF-8."""
    return F.validate_utf8(raw.cast("string"))


def vocabulary_table(spark, v: Vocabulary) -> DataFrame:
    """id, token of merges and special tokens; kind tells them apart."""
    rows = [(i, bytearray(t), "merge") for t, i in v.ranks.items()] + [(i, bytearray(n.encode()), "special") for i, n in v.encoding.special_names().items()]
    return spark.createDataFrame(rows, "id int, token binary, kind string")


def token_id_of(df: DataFrame, v: Vocabulary, token_col: str) -> DataFrame:
    """df with id: that of the merge token of these bytes, -1 if there is none."""
    merges = vocabulary_table(df.sparkSession, v).where("kind = 'merge'").select("id", F.col("token").alias("_token"))
    return df.join(F.broadcast(merges), F.col(token_col).cast("binary") == F.col("_token"), "left").withColumn("id", F.coalesce("id", F.lit(-1))).drop("_token")


def token_bytes(df: DataFrame, v: Vocabulary, id_col: str) -> DataFrame:
    """df with token, length and assigned for each id; token null and length 0 where nothing stands."""
    known = vocabulary_table(df.sparkSession, v).select(F.col("id").alias("_id"), "token")
    d = df.join(F.broadcast(known), F.col(id_col) == F.col("_id"), "left").withColumn("assigned", F.col("_id").isNotNull()).drop("_id")
    return d.withColumn("length", F.coalesce(F.octet_length("token"), F.lit(0)))


def describe(spark, v: Vocabulary) -> DataFrame:
    return spark.createDataFrame([(v.encoding.name, v.n_vocab, v.merge_count, len(v.ranks), len(v.encoding.specials))], "encoding string, n_vocab long, merge_count long, ranks long, specials long")


def vocabulary_diff(spark, a: Vocabulary, b: Vocabulary) -> DataFrame:
    """token, left_id, right_id, change (shared, moved, left, right) over the merge tokens of two vocabularies."""
    x, y = (vocabulary_table(spark, v).where("kind = 'merge'").select("token", F.col("id").alias(n)) for v, n in ((a, "left_id"), (b, "right_id")))
    change = F.when(F.col("left_id").isNull(), "right").when(F.col("right_id").isNull(), "left").when(F.col("left_id") == F.col("right_id"), "shared").otherwise("moved")
    return x.join(y, "token", "full").withColumn("change", change)


def piece_frequency(df: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """piece, n."""
    return spread(df).select(F.explode(T.pieces(F.col(text_col), pattern)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def cache_statistics(df: DataFrame, pattern: str, longest: int = 64, text_col: str = "text") -> DataFrame:
    """pieces, misses, hits, hit_rate that a memo without bound would have on one pass; longer pieces are never kept."""
    f = piece_frequency(df, pattern, text_col)
    kept = F.octet_length("piece") <= longest
    out = f.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum(F.when(kept, 1).otherwise(F.col("n"))), F.lit(0)).alias("misses"))
    return out.select("pieces", "misses", (F.col("pieces") - F.col("misses")).alias("hits"), F.when(F.col("pieces") > 0, (F.col("pieces") - F.col("misses")) / F.col("pieces")).otherwise(0.0).alias("hit_rate"))


FORMATS = {"space": " ", "lines": "\n"}


def format_ids(ids: Column, kind: str = "space") -> Column:
    if kind == "json":
        return F.to_json(ids)
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    return F.array_join(ids.cast("array<string>"), FORMATS[kind])


def parse_ids(text: Column) -> Column:
    """The runs of digits in a text as ids; fails if there is none."""
    found = F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))
    return F.when(F.size(found) == 0, F.raise_error(F.lit("no token ids in the input"))).otherwise(found.cast("array<int>"))


def require_names(v: Vocabulary, names: Iterable[str]) -> None:
    if unknown := [n for n in names if n not in v.encoding.special_ids()]:
        raise SpecialTokenError(f"{v.encoding.name} has no special token {unknown[0]!r}")
