"""Exact passage dedup by a suffix array of many documents, built column by column.

A byte is removed if a LENGTH-byte string covers it that also starts in a document with a smaller doc_id.

1. Every LENGTH-byte window of a text has a minimizer, the GRAM-byte string in it with the least hash; equal windows have equal
   minimizers. Minimizers (40-bit hashes) that occur in one document only are dropped: a window of theirs occurs nowhere else.
2. Maximal runs of windows with one minimizer are cut out as short strings, equal ones of a chunk of documents once with the least
   doc_id, and dealt by the minimizer, so all equal windows meet in one bucket. A minimizer with more than HOT_STRINGS strings
   (distinct in their chunk) would fill a bucket: its windows are strings of their own, dealt by their own hash.
3. A bucket sorts all suffixes of its strings by column-wise insertion: each round puts one more symbol of every string, from the
   right, into the collection's Burrows-Wheeler transform; the place of a new suffix follows from its tail's place by counting
   symbols (LF mapping), and its common prefixes with both neighbours are one more than the least on the way between the tails.
   Neighbours in the finished order with a common prefix of LENGTH bytes are equal windows; the least doc_id of such a group goes
   back to the chunks, which mark and remove.

Rounds are bounded by the strings' length, at most 2 * LENGTH - GRAM bytes, whatever the documents' length. Between the steps the
strings stand in shuffle files that are written and read in sequence; a task holds one chunk or one bucket. A row between a chunk
and a bucket holds one string at least, so rows never outnumber strings, however many chunks and buckets there are.

Defined cases: null text counts as empty; texts shorter than LENGTH keep all bytes; rows of one doc_id do not repeat each other; a
null doc_id is larger than all others; equal rows are all kept; a text of any length is one text, in one chunk; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.minhash import _BYTES, _powers, mix64, range_hashes
from tokenloom.operators.batch import stretches

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
CHUNK_BYTES = 4 << 20
MOST_AT_ONCE = 1 << 24
PART_STRINGS = 4000  #: strings sorted at a time, unless one minimizer has more
HOT_STRINGS, MANY_RUNS = 200_000, 8
HASH_BITS = 40
WIDE = 7  #: pairs more than 2**WIDE places apart are compared by blocks of so many
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
LAST = np.iinfo(np.int64).max


def minimizers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the position of its minimizer (the leftmost of equals); for each position: the 40-bit hash there."""
    if len(raw) > MOST_AT_ONCE:  # a position has 24 bits beside its hash
        step = MOST_AT_ONCE - LENGTH + 1
        parts = [minimizers(raw[a : a + MOST_AT_ONCE]) for a in range(0, len(raw) - LENGTH + 1, step)]
        at = np.concatenate([p + i * step for i, (p, _) in enumerate(parts)])
        return at, np.concatenate([h[:step] for _, h in parts[:-1]] + [parts[-1][1]])
    power, inverse = _powers(1 << max(18, int(len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=sums[1:])
    n = len(raw) - GRAM + 1
    h = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[:n]) >> np.uint64(24)
    least, width = h << np.uint64(24) | np.arange(n, dtype=np.uint64), 1
    while width * 2 <= SPAN:
        least = np.minimum(least[width:], least[:-width])
        width *= 2
    if (rest := SPAN - width) > 0:
        least = np.minimum(least[rest:], least[:-rest])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64), h


def _hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[begin : begin + size], from prefix sums over stretches of raw that need no large table of powers."""
    out, step = np.zeros(len(begin), np.uint64), 1 << 17
    most = int(size.max(initial=0))
    for low in range(0, len(raw), step):
        own = (begin >= low) & (begin < low + step)
        if own.any():
            at = begin[own] - low
            out[own] = range_hashes(raw[low : low + step + most], at, at + size[own])
    return out


class Chunk:
    """The texts of a chunk, one after the other, and the runs of windows with one minimizer."""

    def __init__(self, table: pa.Table):
        t = table.combine_chunks()
        ids = t.column("doc_id").to_pylist()
        raws = t.column("raw").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raws[i]))
        self.ids, self.texts = [ids[i] for i in order], [raws[i] for i in order]
        self.docs = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(x) for x in self.texts])
        self.first = self.count = self.gram = self.owner = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        parts = []
        start = 0
        while start < len(self.texts):  # some texts at a time
            stop, low = start + 1, int(self.ends[start]) - len(self.texts[start])
            while stop < len(self.texts) and self.ends[stop] - low < 1 << 17:
                stop += 1
            parts.append(self._runs(start, stop, low, int(self.ends[stop - 1])))
            start = stop
        parts = [p for p in parts if p]
        if parts:
            self.first, self.count, self.gram, self.owner, self.hash = (np.concatenate(c) for c in zip(*parts, strict=True))

    def _runs(self, start, stop, low, high):
        if high - low < LENGTH:
            return None
        at, h = minimizers(self.raw[low:high])
        owner = np.repeat(np.arange(start, stop), [len(x) for x in self.texts[start:stop]])[: len(at)]
        inside = np.arange(len(at)) + LENGTH <= (self.ends[owner] - low)
        edge = np.ones(len(at), bool)
        edge[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge & inside)
        if not len(first):
            return None
        run = np.cumsum(edge & inside) - 1
        count = np.bincount(run[inside], minlength=len(first))
        return first + low, count, at[first] + low, owner[first], h[at[first]]

    def keep(self, shared: np.ndarray) -> None:
        """Keeps the runs of these minimizers; those of hot ones, marked by one more bit, are parted into single windows."""
        ok = np.isin(self.hash, shared & HASH_MASK)
        self.first, self.count, self.gram, self.owner, self.hash = (c[ok] for c in (self.first, self.count, self.gram, self.owner, self.hash))
        hot = np.isin(self.hash, shared[shared > HASH_MASK] & HASH_MASK)
        if hot.any():
            n, cold = self.count[hot], ~hot
            first = stretches(self.first[hot], n)
            split = (first, np.ones(len(first), np.int64), np.repeat(self.gram[hot], n), np.repeat(self.owner[hot], n), _hashes(self.raw, first, np.full(len(first), LENGTH)) >> np.uint64(64 - HASH_BITS))
            old = (self.first, self.count, self.gram, self.owner, self.hash)
            self.first, self.count, self.gram, self.owner, self.hash = (np.concatenate([c[cold], x]) for c, x in zip(old, split, strict=True))

    def strings(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings in order of their first run; of each run: its string; of each string: least doc, minimizer's hash."""
        raw, number, of = self.raw.tobytes(), {}, np.empty(len(self.first), np.int64)
        for k, (a, n) in enumerate(zip(self.first.tolist(), self.count.tolist(), strict=True)):
            of[k] = number.setdefault(raw[a : a + n - 1 + LENGTH], len(number))
        least = np.full(len(number), LAST)
        np.minimum.at(least, of, self.docs[self.owner])
        hashes = np.zeros(len(number), np.uint64)
        hashes[of] = self.hash
        return list(number), of, least, hashes


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mix64(hashes) % np.uint64(n)).astype(np.int64)


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a + 1 : b + 1]) for each pair a < b."""
    if not len(a):
        return np.zeros(0, values.dtype)
    level = np.frexp((b - a).astype(np.float32))[1] - 1  # 2**level <= gap
    most, n = int(level.max()), len(values)
    near = np.minimum(level, WIDE)
    table = np.empty((min(most, WIDE) + 1, n), values.dtype)  # [k, i]: the least of 2**k values from i on
    table[0] = values
    for k in range(len(table) - 1):
        np.minimum(table[k, : n - (1 << k)], table[k, 1 << k :], out=table[k + 1, : n - (1 << k)])
    flat, row = table.reshape(-1), near.astype(np.int64) * n
    out = np.minimum(flat[row + a + 1], flat[row + b + 1 - (1 << near.astype(np.int64))])
    if most > WIDE:  # the ends are done; between them stand whole blocks
        far = np.flatnonzero(level > WIDE)
        first, stop = (a[far] >> WIDE) + 1, b[far] + 1 >> WIDE
        some = first < stop
        far, first, stop = far[some], first[some], stop[some]
        if len(far):
            out[far] = np.minimum(out[far], _least_between(table[WIDE, : n - (1 << WIDE) + 1 : 1 << WIDE], first - 1, stop - 1))
    return out


def sorted_suffixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, common prefix with the one before) of all non-empty suffixes in lexicographic order, by column-wise insertion.

    In a round, the suffixes that a symbol precedes stand, with it, in their old order: those that end up beside a new one come
    from the nearest places with the same symbol before and after its tail, so their common prefix is one more than the least
    between these places. No other neighbours change.
    """
    k = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    last = np.cumsum(size) - 1
    prior = lambda s, done: flat[last[s] - done].astype(np.uint16) + 1
    live = place = np.arange(k)
    bwt = prior(live, 0)  # of the empty suffixes, by string; 0: the string is done
    common = np.zeros(k, np.uint8)
    number = np.int32 if k < 1 << 23 else np.int64
    name = (live << 8).astype(number)  # string and length of each suffix
    done = finished = 0
    while len(live):
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        own = rank[place]
        new = own + (k - finished)
        beside = np.concatenate([order[np.maximum(own - 1, 0)], order[np.minimum(own + 1, n - 1)]])
        tails = np.concatenate([place, place])
        some = (beside != tails) & (bwt[beside] == bwt[tails])
        beside, tails = beside[some], tails[some]
        shared = np.zeros(2 * len(live), np.uint8)
        shared[some] = 1 + _least_between(common, np.minimum(beside, tails), np.maximum(beside, tails))
        done += 1
        more = size[live] > done
        symbol = np.zeros(len(live), np.uint16)
        symbol[more] = prior(live[more], done)
        grown = np.ones(n + len(live), bool)
        grown[new] = False
        both, names, prefixes = np.empty(len(grown), np.uint16), np.empty(len(grown), number), np.zeros(len(grown) + 1, np.uint8)
        both[grown], both[new] = bwt, symbol
        names[grown], names[new] = name, live << 8 | done
        prefixes[:-1][grown] = common
        prefixes[new + 1] = shared[len(live) :]
        prefixes[new] = shared[: len(live)]
        bwt, name, common = both, names, prefixes[:-1]
        finished += int(len(live) - more.sum())
        place, live = new[more], live[more]
    who = (name[k:] >> 8).astype(np.int64)
    return who, size[who] - (name[k:] & 255), common[k:]


def equal_windows(strings: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each string and window in it: the least doc of all strings that hold the same window."""
    spread, begin, count = window_minima(strings, least)
    return [spread[b : b + n] for b, n in zip(begin.tolist(), count.tolist(), strict=True)]


def window_minima(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least docs by byte of the joined strings; of each string: where its windows begin there, and how many there are."""
    who, off, common = sorted_suffixes(strings)
    size = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(size) - size
    full = size[who] - off >= LENGTH
    who, off, new = who[full], off[full], common[full] < LENGTH
    at = begin[who] + off
    group = np.cumsum(new) - 1
    mins = np.minimum.reduceat(least[who], np.flatnonzero(new)) if len(at) else np.zeros(0, np.int64)
    spread = np.full(int(size.sum()), LAST)
    spread[at] = mins[group]
    return spread, begin, size - LENGTH + 1


def in_parts(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``window_minima``, with the strings taken by their minimizers in parts that a processor's cache holds."""
    at, h = minimizers(np.frombuffer(b"".join(strings), np.uint8))
    size = np.array([len(s) for s in strings], np.int64)
    part = _buckets(mix64(h[at[np.cumsum(size) - size]]), -(-len(strings) // PART_STRINGS))
    order = np.argsort(part, kind="stable")
    begin, count, done, spreads = np.empty(len(strings), np.int64), size - LENGTH + 1, 0, []
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        spread, first, _ = window_minima([strings[i] for i in own], least[own])
        begin[own] = first + done
        done += len(spread)
        spreads.append(spread)
    return np.concatenate(spreads), begin, count


def _announce(n_buckets: int):
    def work(table: pa.Table) -> pa.Table:
        c = Chunk(table)
        kinds, back = np.unique(c.hash, return_inverse=True)
        least, most = np.full(len(kinds), LAST), np.full(len(kinds), np.iinfo(np.int64).min)
        np.minimum.at(least, back, c.docs[c.owner])
        np.maximum.at(most, back, c.docs[c.owner])
        strings = np.bincount(back, minlength=len(kinds))
        often = np.flatnonzero((strings >= MANY_RUNS)[back])  # equal strings count once where there can be many
        _, one = np.unique(_hashes(c.raw, c.first[often], c.count[often] - 1 + LENGTH), return_index=True)
        strings[strings >= MANY_RUNS] = np.bincount(back[often[one]], minlength=len(kinds))[strings >= MANY_RUNS]
        power = np.frexp(np.maximum(strings, 1).astype(np.float64))[1].astype(np.uint64)  # fewer than 2**power strings
        flagged = power << np.uint64(HASH_BITS + 1) | kinds << np.uint64(1) | (least < most)
        bucket = _buckets(kinds, n_buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        chunk = table.column("chunk")[0].as_py()
        raw = [g.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for g in np.split(flagged[order], cuts[1:])] if len(kinds) else []
        return pa.table({"bucket": pa.array(bucket[order][cuts], pa.int64()), "chunk": pa.array([chunk] * len(raw), pa.int64()), "blob": pa.array(raw, pa.binary())})

    return work


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _answer(hot_strings: int):
    def work(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        values = [_unpack(b) for b in table.column("blob").to_pylist()]
        key = np.concatenate(values)
        kinds, back, counts = np.unique(key >> np.uint64(1) & HASH_MASK, return_inverse=True, return_counts=True)
        flag = np.bincount(back, (key & np.uint64(1)) == 1, len(kinds)) > 0
        strings = np.bincount(back, np.exp2((key >> np.uint64(HASH_BITS + 1)).astype(np.float64) - 1), len(kinds))
        told = (kinds | (strings > hot_strings).astype(np.uint64) << np.uint64(HASH_BITS))[back]
        shared = ((counts > 1) | flag)[back]
        out, start = [], 0
        for v in values:
            hit = shared[start : start + len(v)]
            out.append(told[start : start + len(v)][hit].tobytes())
            start += len(v)
        some = [i for i, b in enumerate(out) if b]
        return pa.table({"chunk": pa.array([chunks[i] for i in some], pa.int64()), "kind": pa.array([0] * len(some), pa.int32()), "blob": pa.array([out[i] for i in some], pa.binary()), "more": pa.array([b""] * len(some), pa.binary())})

    return work


def _ready(docs: pa.Table, answers: pa.Table) -> Chunk:
    c = Chunk(docs)
    kinds = answers.column("kind").to_pylist()
    blobs = [b for k, b in zip(kinds, answers.column("blob").to_pylist(), strict=True) if k == 0]
    c.keep(np.frombuffer(b"".join(blobs), np.uint64))
    return c


def _deal(n_buckets: int):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names, kinds = ["bucket", "chunk", "numbers", "sizes", "least", "strings"], [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        if not docs.num_rows or not answers.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        strings, _, least, hashes = _ready(docs, answers).strings()
        bucket = _buckets(hashes, n_buckets)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            own = [strings[i] for i in group]
            rows.append((int(bucket[group[0]]), docs.column("chunk")[0].as_py(), group.astype("<i4").tobytes(), bytes(map(len, own)), least[group].astype("<i8").tobytes(), pa.compress(b"".join(own), "zstd", asbytes=True)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return work


def _match(table: pa.Table) -> pa.Table:
    number: dict[bytes, int] = {}
    of, least = [], []
    for sizes, docs, packed in zip(*(table.column(c).to_pylist() for c in ("sizes", "least", "strings")), strict=True):
        raw = pa.decompress(packed, sum(sizes), "zstd", asbytes=True)
        at, own = 0, []
        for n, d in zip(sizes, np.frombuffer(docs, "<i8").tolist(), strict=True):
            k = number.setdefault(raw[at : at + n], len(number))
            if k == len(least):
                least.append(d)
            else:
                least[k] = min(least[k], d)
            own.append(k)
            at += n
        of.append(own)
    spread, begin, count = in_parts(list(number), np.array(least, np.int64))
    more = [spread[stretches(begin[own], count[own])].astype("<i8").tobytes() for own in of]
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([1] * len(of), pa.int32()), "blob": table.column("numbers"), "more": pa.array(more, pa.binary())})


def _remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    if not docs.num_rows:
        return pa.table([pa.array([], k) for k in types], names)
    c = _ready(docs, answers) if answers.num_rows else Chunk(docs)
    cover = np.zeros(len(c.raw) + 1, np.int32)
    if answers.num_rows:
        strings, of, _, _ = c.strings()
        begin, done, mins = np.empty(len(strings), np.int64), 0, []
        windows = np.array([len(x) for x in strings], np.int64) - LENGTH + 1
        for kind, blob, more in zip(*(answers.column(x).to_pylist() for x in ("kind", "blob", "more")), strict=True):
            if kind == 1:
                own = np.frombuffer(blob, "<i4")
                begin[own] = done + np.cumsum(windows[own]) - windows[own]
                mins.append(np.frombuffer(more, "<i8"))
                done += len(mins[-1])
        if len(of):
            earlier = np.concatenate(mins)[stretches(begin[of], c.count)] < np.repeat(c.docs[c.owner], c.count)
            hit = stretches(c.first, c.count)[earlier]
            cover[hit] += 1  # windows of one text start at different bytes
            cover[hit + LENGTH] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    rows, start = [], 0
    for doc, text in zip(c.ids, c.texts, strict=True):
        own = gone[start : start + len(text)]
        kept = c.raw[start : start + len(text)][~own].tobytes() if own.any() else text
        spans = int((own & ~np.concatenate([[False], own[:-1]])).sum()) if len(text) else 0
        rows.append((doc, len(text), int(own.sum()), spans, kept))
        start += len(text)
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], names)


def _digest(docs: pa.Table, answers: pa.Table) -> pa.Table:
    t = _remove(docs, answers)
    return t.set_column(4, "kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in t.column("kept").to_pylist()], pa.string()))


def _run(docs: DataFrame, last, schema: str, hot_strings: int) -> DataFrame:
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    total = raw.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = int(-(-total // CHUNK_BYTES)) or 1
    chunked = raw.select(F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n)).alias("chunk"), "doc_id", "raw").groupBy("chunk")
    hashes = chunked.applyInArrow(_announce(-(-n // 3)), "bucket long, chunk long, blob binary")
    shared = hashes.groupBy("bucket").applyInArrow(_answer(hot_strings), "chunk long, kind int, blob binary, more binary")
    dealt = chunked.cogroup(shared.groupBy("chunk")).applyInArrow(_deal(n), "bucket long, chunk long, numbers binary, sizes binary, least binary, strings binary")
    matched = dealt.groupBy("bucket").applyInArrow(_match, "chunk long, kind int, blob binary, more binary")
    return chunked.cogroup(shared.unionByName(matched).groupBy("chunk")).applyInArrow(last, schema)


def removed_digests(docs: DataFrame, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    return _run(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot_strings)


def remove_repeats(docs: DataFrame, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each row of docs."""
    return _run(docs, _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", hot_strings)
