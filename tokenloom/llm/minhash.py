"""Near-duplicate documents by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

For each element of a set, SuperMinHash draws a random permutation of the slots together with uniform numbers: in step j the
element offers j + u to one slot. A slot keeps the least offer. Offers of step j are at least j, so a set is done as soon as its
largest slot is below j + 1: after two or three steps for most texts. Here all elements of many texts take each step together.

Texts with equal sets are one class. BANDS x ROWS slots make the chance to miss a pair at the threshold about 5e-8. Classes that
share a band are verified against that class of the band first which most others share bands with. Pairs that share a band and are
still in different components after that are all verified, unless their sizes rule the threshold out. The component with most classes
of a band is its main one. Its classes stand once, in blocks; those of other components that share a band with it are sent to its
blocks until they are linked. Pairs of which neither is in the main component meet band by band, each in the first band that it
shares. So a large group of near-copies is read once, however many bands it fills and however few others share these.

Defined cases: null or empty text and text without words have the empty set, which links with nothing; a text with fewer than
``words`` words has the sequence of them as its only shingle; equal rows and rows of one doc_id are all returned; a null doc_id
is never the smallest; a similarity that equals the threshold links; a text of any length is read whole, its set signed in parts; an
empty table gives an empty result; other columns are ignored. A doc_id may stand for several texts, and null for any number of them:
groups are made of texts, not of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import caches
from tokenloom.llm.components import UnionFind, components
from tokenloom.llm.scratch import Scratch

WORDS, THRESHOLD = 5, (80, 100)
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
BLOCK_BYTES, BLOCK_SETS = 1 << 18, 1 << 15
UNIT_SETS = 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD, _ODD_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8").astype(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, p, np.uint64))]) for p in (_ODD, _ODD_INVERSE))


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], from prefix sums of a polynomial over random numbers for bytes."""
    power, inverse = _powers(1 << max(18, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * power[: len(raw)])])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; texts must not be too long for one array together."""
    raw = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    h = range_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    bound = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    grams = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        grams = mix64(grams + h[k : len(h) - words + 1 + k])
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix64(np.array([(int(whole) + int(x)) % 2**64], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set: SLOTS numbers, step in the upper and fraction in the lower 32 bits."""
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= BLOCK_SETS):
            total += len(sets[stop])
            stop += 1
        for a in range(0, max(total, 1), BLOCK_SETS):  # one set larger than a block: its parts, then the least of both
            part = sets[start:stop] if total <= BLOCK_SETS else [sets[start][a : a + BLOCK_SETS]]
            out[start:stop] = np.minimum(out[start:stop], _sign(part))
        start = stop
    return out


def _sign(sets: list[np.ndarray]) -> np.ndarray:
    h = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    x, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    deck = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(x), 1))
    for j in range(SLOTS):
        rows = np.arange(len(x))
        z = mix64(x + np.uint64((j + 1) * int(_ODD) % 2**64))
        k = j + ((z >> np.uint64(32)) * np.uint64(SLOTS - j) >> np.uint64(32)).astype(np.int64)
        slot = deck[rows, k]
        deck[rows, k] = deck[:, j]
        offer = np.uint64(j << 32) | (z & np.uint64(0xFFFFFFFF))
        np.minimum.at(h.reshape(-1), owner * SLOTS + slot, offer)
        live = h.max(1) >= np.uint64(j + 1 << 32)
        keep = live[owner]
        if not keep.any():
            break
        if not keep.all():
            x, owner, deck = x[keep], owner[keep], deck[keep]
    return h


def band_keys(sign: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sign), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mix64(out + sign[:, r::ROWS])
    return out.view(np.int64)


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    start, some, size = 0, [], 0
    for i in range(len(column)):
        t = (column[i].as_py() or "").encode()
        if some and size + len(t) > BLOCK_BYTES:
            yield start, some
            start, some, size = i, [], 0
        some.append(t)
        size += len(t)
    if some:
        yield start, some


def _digest() -> F.Column:
    return F.unhex(F.md5("text"))


def signed(docs: DataFrame, words: int, carried: list[str]) -> DataFrame:
    """doc_id and the carried columns, digest of the text, n_shingles, class (hash of the set; null: empty), bands."""
    names = ["doc_id", *carried, "digest"]
    docs = docs.withColumn("digest", _digest())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("minhash", _powers.cache_clear)
        for b in batches:
            for start, texts in _blocks(b.column("text")):
                sets = shingle_sets(texts, words)
                keys = band_keys(signatures(sets))
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c).slice(start, len(texts)) for c in names), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if len(s) else [] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                ], [*names, "n_shingles", "class", "bands"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "text").mapInArrow(work, f"{kinds}, n_shingles long, class binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets reach the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = THRESHOLD
        last: tuple = (None, None)
        for b in batches:
            u, v = [], []
            for i in range(b.num_rows):
                x, y = b.column("u")[i].as_py(), b.column("v")[i].as_py()
                if last[0] != y:
                    last = (y, shingle_sets([b.column("text_v")[i].as_py().encode()], words)[0])
                [a] = shingle_sets([b.column("text_u")[i].as_py().encode()], words)
                both = len(np.intersect1d(a, last[1], assume_unique=True))
                if whole * both >= part * (len(a) + len(last[1]) - both):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    t = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(t("u"), "u").join(t("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(work, "u binary, v binary")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    part, whole = THRESHOLD
    both = len(np.intersect1d(x, y, assume_unique=True))
    return whole * both >= part * (len(x) + len(y) - both)


class _Unit:
    """The classes of a work unit: their rows' columns, and the full sets of shingles."""

    def __init__(self, table: pa.Table, words: int):
        t = table.combine_chunks()
        self.table, self.name, self.comp = t, t.column("class").to_pylist(), t.column("c").to_pylist()
        self.bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
        known: dict[bytes, np.ndarray] = {}
        for k, x in zip(self.name, t.column("text"), strict=True):
            if k not in known:
                known[k] = shingle_sets([x.as_py().encode()], words)[0]
        self.sets = [known[k] for k in self.name]
        self.n = np.array([len(x) for x in self.sets])

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose sizes allow a link."""
        part, whole = THRESHOLD
        return others[np.minimum(self.n[others], self.n[i]) * whole >= np.maximum(self.n[others], self.n[i]) * part]

    def groups(self, column: str) -> list[np.ndarray]:
        keys = {k: i for i, k in enumerate(dict.fromkeys(self.table.column(column).to_pylist()))}
        group = np.array([keys[k] for k in self.table.column(column).to_pylist()])
        order = np.argsort(group, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(group[order])) + 1)

    def links(self, pairs: list[tuple[int, int]]) -> pa.Table:
        return pa.table({"u": pa.array([self.name[i] for i, _ in pairs], pa.binary()), "v": pa.array([self.name[j] for _, j in pairs], pa.binary())})


def _in_units(rows: DataFrame, key: str, work, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that work finds: rows (key, blocks, a, b, class, c, ...) of several blocks meet by key, a, b, others some UNIT_SETS together."""
    rows = scratch.cut(rows)
    small = -(-rows.where("blocks = 1").count() // UNIT_SETS) or 1
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(key), F.lit(small))).otherwise(F.xxhash64(key))
    rows = rows.withColumns({"many": F.col("blocks") == 1, "unit": unit}).join(classes.select("class", "bands"), "class").join(texts.select("class", "text"), "class")
    return rows.groupBy("many", "unit", "a", "b").applyInArrow(work, "u binary, v binary")


def _across(crowded: DataFrame, found: DataFrame, classes: DataFrame, texts: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """Links between classes that share a band and are in different components so far: enough of them to connect what they connect.

    Classes meet in blocks of some UNIT_SETS. Pairs are never rows: a unit returns the links that it found.
    """
    c = crowded.join(found.withColumnsRenamed({"node": "class", "root": "c"}), "class", "left").select("band", "class", F.coalesce("c", "class").alias("c"))
    sizes = c.groupBy("band", "c").agg(F.count(F.lit(1)).alias("many"))
    top = sizes.groupBy("band").agg(F.max(F.struct("many", "c")).alias("top"), F.count(F.lit(1)).alias("several")).where("several > 1").select("band", F.col("top.c").alias("main"))
    c = scratch.cut(c.join(top, "band"))
    own, rest = c.where("c = main").select("main", "class", "c").distinct(), c.where("c <> main")
    blocks = own.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / UNIT_SETS).cast("int").alias("blocks"))
    own = own.join(blocks, "main").select("main", "blocks", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("a"), F.lit(True).alias("own"), "class", "c")
    guests = rest.select("main", "class", "c").distinct().join(blocks, "main")
    guests = guests.select("main", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), F.lit(False).alias("own"), "class", "c")

    def with_main(table: pa.Table) -> pa.Table:
        t, pairs = _Unit(table, words), []
        home = np.asarray(t.table.column("own"))
        for rows in t.groups("main"):
            ours, done = rows[home[rows]], set()
            for i in rows[~home[rows]].tolist():
                if t.comp[i] not in done:
                    others = t.alike(i, ours)
                    for j in others[(t.bands[others] == t.bands[i]).any(1)].tolist():
                        if _linked(t.sets[i], t.sets[j]):
                            done.add(t.comp[i])
                            pairs.append((i, j))
                            break
        return t.links(pairs)

    links = _in_units(own.unionByName(guests).withColumn("b", F.col("a")), "main", with_main, classes, texts, scratch)
    mixed = rest.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count(F.lit(1)) / UNIT_SETS).cast("int").alias("blocks")).where("lo <> hi").select("band", "blocks")
    rest = rest.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("band", "blocks", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), F.col("block").alias("own"), "class", "c")

    def in_band(table: pa.Table) -> pa.Table:
        t, pairs, sets = _Unit(table, words), [], UnionFind()
        block, band = np.asarray(t.table.column("own")), np.asarray(t.table.column("band"))
        a, b = t.table.column("a")[0].as_py(), t.table.column("b")[0].as_py()
        comp = np.array(t.comp, object)
        for rows in t.groups("band"):
            at = int(np.flatnonzero(t.bands[rows[0]] == band[rows[0]])[0])  # which of a class's bands it is
            for k, i in enumerate(rows.tolist()):
                if block[i] == a:
                    others = t.alike(i, rows[k + 1 :] if a == b else rows[block[rows] != a])
                    others = others[comp[others] != comp[i]]
                    for j in others[(t.bands[others, :at] != t.bands[i, :at]).all(1)].tolist():  # no earlier band in common
                        if sets.find(comp[i]) != sets.find(comp[j]) and _linked(t.sets[i], t.sets[j]):
                            sets.union(comp[i], comp[j])
                            pairs.append((i, j))
        return t.links(pairs)

    return links.unionByName(_in_units(rest, "band", in_band, classes, texts, scratch))


def grouped(docs: DataFrame, words: int, carried: list[str]) -> DataFrame:
    """doc_id and the carried columns, n_shingles, class, root (class that names the group; null: empty set), component_id for each row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.cut(signed(docs, words, carried))
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "digest")).alias("stands"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.cut(classes)
    members = classes.select("class", "n", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    crowded = scratch.cut(members.join(sizes, "band"))
    known = crowded.groupBy("class").agg(F.sum("many").alias("known"))  # in how many others' bands it is: most for an original
    crowded = scratch.cut(crowded.drop("many").join(known, "class"))
    centre = crowded.groupBy("band").agg(F.max(F.struct("known", "class", "n")).alias("top")).select("band", F.col("top.class").alias("v"), F.col("top.n").alias("n_v"))
    star = crowded.join(centre, "band").where(F.col("class") != F.col("v")).where(_may_link("n", "n_v")).select(F.col("class").alias("u"), "v")
    star = scratch.cut(star.distinct())
    # A class finds its text by doc_id and digest: the id alone can be null, or stand for the text of another class.
    ids = classes.join(crowded.select("class").distinct(), "class", "left_semi").select(F.col("stands.doc_id").alias("_id"), F.col("stands.digest").alias("_digest"), "class")
    known = docs.select("doc_id", "text", _digest().alias("digest"))
    known = known.join(ids, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = scratch.cut(known.select("class", "text").dropDuplicates(["class"]))
    links = scratch.cut(_verified(star, texts, words))
    found = components(links, scratch)
    links = links.unionByName(scratch.cut(_across(crowded, found, classes, texts, words, scratch)))
    found = components(links, scratch)
    least = found.join(classes.select(F.col("class").alias("node"), "least_id"), "node").groupBy("root").agg(F.min("least_id").alias("least_id"))
    least = least.join(classes.select(F.col("class").alias("root"), F.col("least_id").alias("own")), "root").select("root", F.least("own", "least_id").alias("component"))
    named = found.join(least, "root").select(F.col("node").alias("class"), "root", "component").unionByName(least.select(F.col("root").alias("class"), "root", "component"))
    named = classes.join(named, "class", "left").select("class", F.coalesce("root", "class").alias("root"), F.coalesce("component", "least_id").alias("component_id"))
    out = rows.drop("bands", "digest").join(named, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", *carried, "n_shingles", "class", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, class, component_id (smallest doc_id reachable), kept (doc_id = component_id) for each row of docs."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return grouped(docs, words, []).select("doc_id", "n_shingles", "class", "component_id", kept.alias("kept"))


def _may_link(a: str, b: str) -> F.Column:
    part, whole = THRESHOLD
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def representatives(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of docs for each group of near-duplicates: that of the smallest doc_id, null last; of several such rows, any one."""
    scratch = Scratch(docs.sparkSession, "representatives")
    numbered = scratch.cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    rows = scratch.cut(grouped(numbered, words, ["_row"]).select("doc_id", "_row", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    kept = rows.where("root is not null").groupBy("root").agg(first.alias("first")).select("first._row")
    kept = kept.unionByName(rows.where("root is null").select("_row"))
    return numbered.join(kept, "_row", "left_semi").select(*docs.columns)
