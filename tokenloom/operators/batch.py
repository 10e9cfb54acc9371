"""Token ids of many texts at once: Arrow cuts the texts into words, each distinct word is looked up or encoded once, and numpy
puts the ids together.

No piece goes on over a single space between visible characters, whatever the pattern, so texts are cut there. Texts with other
white space beside a space are encoded as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together.
GROUP_BYTES = 4_000_000


class Memo:
    """What is known of pieces or words, up to ``capacity`` entries of at most ``longest`` characters; 0 disables it.

    Nothing is evicted: once it is full, or for what is too long, an entry is rejected. hits and misses count occurrences. Of a batch
    of words, those that occur fewer than ``least`` times in it are not kept: they would take the place of common ones.
    """

    def __init__(self, capacity: int, longest: int = 64, least: int = 1):
        if capacity < 0:
            raise ValueError("the capacity must not be negative")
        self.capacity, self.longest, self.least = capacity, longest, least
        self.entries: dict = {}
        self.hits = self.misses = self.rejected = 0

    @property
    def enabled(self) -> bool:
        return self.capacity > 0

    @property
    def hit_rate(self) -> float:
        used = self.hits + self.misses
        return self.hits / used if used else 0.0

    def __len__(self) -> int:
        return len(self.entries)

    def get(self, key: str):
        found = self.entries.get(key)
        self.hits += found is not None
        self.misses += found is None
        return found

    def put(self, key: str, value) -> bool:
        """Whether the entry is kept."""
        if len(key) > self.longest or len(self.entries) >= self.capacity and key not in self.entries:
            self.rejected += 1
            return False
        self.entries[key] = value
        return True

    def look_up(self, keys: list[str], times: np.ndarray, make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of distinct keys, each asked for so many times; ``make`` gives those that are not known."""
        known = self.entries.get
        out = [known(k) for k in keys]
        new = [i for i, v in enumerate(out) if v is None]
        self.hits += int(times.sum())
        for i, v in zip(new, make([keys[i] for i in new]) if new else (), strict=True):
            out[i] = v
            kept = times[i] >= self.least and self.put(keys[i], v)
            self.hits -= 1 if kept else int(times[i])
            self.misses += 1 if kept else int(times[i])
        return out


def stretches(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), then the same from begin[1], and so on."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


def groups(column: pa.Array, most: int = GROUP_BYTES) -> list[pa.Array]:
    """A text column in slices of some ``most`` bytes, of one text at least."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    return [column.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


class Ids:
    """Token ids of texts: entry k stands for flat[begin[k] : begin[k] + size[k]]; text i is the entries up to its end."""

    def __init__(self, known: list[bytes], entry: np.ndarray, parts: np.ndarray):
        self.size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(known), "<i4")
        self.entry, self.parts = entry, parts

    def counts(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.size[self.entry])])
        ends = np.cumsum(self.parts)
        return sums[ends] - sums[ends - self.parts]

    def ids(self) -> np.ndarray:
        return self.flat[stretches(self.begin[self.entry], self.size[self.entry])]


def encode_texts(
    texts: pa.Array, memo: Memo, words: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], uncut: Callable[[int], bytes] | None = None, apart: np.ndarray | None = None
) -> Ids:
    """texts: strings without nulls. words: ids of a space and each of these words, whole: ids of these texts; both as little-endian
    32-bit numbers. ``apart`` marks texts that are not to be cut; ``uncut`` gives the ids of a text that is not cut, by its index."""
    split = pc.split_pattern(texts, pattern=" ")
    ends = split.offsets.to_numpy().astype(np.int64)
    heads, n = ends[:-1], np.diff(ends)
    coded = split.values.dictionary_encode()
    codes, kinds = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    bare, right = pc.utf8_ltrim_whitespace(coded.dictionary), pc.utf8_rtrim_whitespace(coded.dictionary)
    owner = np.repeat(np.arange(len(n)), n)
    head = np.zeros(len(codes), bool)
    head[heads] = True
    closed = pc.or_(pc.equal(coded.dictionary, ""), pc.not_equal(right, coded.dictionary)).to_numpy(zero_copy_only=False)
    edged = closed | pc.not_equal(bare, coded.dictionary).to_numpy(zero_copy_only=False)
    cut = n > 1
    if apart is not None:
        cut &= ~apart
    cut &= ~closed[codes[heads]]
    cut[owner[~head & edged[codes]]] = False
    rest = ~head & cut[owner]
    used, times = np.unique(codes[rest], return_counts=True)
    known = memo.look_up([kinds[k] for k in used.tolist()], times, words)
    place = np.empty(len(kinds), np.int64)
    place[used] = np.arange(len(used))
    entry = np.empty(len(codes), np.int64)
    entry[rest] = place[codes[rest]]
    first = np.unique(codes[heads[cut]])
    place[first] = len(known) + np.arange(len(first))
    known += whole([kinds[k] for k in first.tolist()])
    entry[heads[cut]] = place[codes[heads[cut]]]
    rows = np.flatnonzero(~cut)
    entry[heads[rows]] = len(known) + np.arange(len(rows))
    known += [uncut(i) for i in rows.tolist()] if uncut else whole(texts.take(pa.array(rows)).to_pylist())
    return Ids(known, entry[rest | head], np.where(cut, n, 1))
