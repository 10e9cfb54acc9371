"""The merge, and encoding of batches with a bounded memo. Runs in Python workers; the only part that isn't columns."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tokenloom.functions.patterns import split
from tokenloom.operators.batch import Ids, Memo, encode_texts

#: Of at most MEMO_PIECE characters each, some 200 bytes with its ids: 30 MB for a worker at most.
MEMO_ENTRIES = 150_000
MEMO_PIECE = 64
SCAN_LIMIT = 48


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: itself if it is a token, else the lowest-ranked adjacent pair merges, again and again."""
    if not piece:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return _merge_short(piece, ranks) if len(piece) <= SCAN_LIMIT else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + (1 << 40)
    get = ranks.get
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same over start offsets with a heap, for pieces of any length."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def as_text(raw: bytes | str) -> str:
    return raw if isinstance(raw, str) else raw.decode("utf-8", "surrogateescape")


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


class Kernel:
    """Encodes texts of one encoding, with one memo of words and one of the sizes of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_entries: int = MEMO_ENTRIES, memo_piece: int = MEMO_PIECE):
        self.ranks, self.pattern = ranks, pattern
        self.memo, self.sizes = Memo(memo_entries, memo_piece), Memo(memo_entries, memo_piece)

    def forget(self) -> None:
        self.memo, self.sizes = Memo(self.memo.capacity, self.memo.longest), Memo(self.sizes.capacity, self.sizes.longest)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return np.array([i for p in split(text, self.pattern) for i in merge(as_bytes(p), self.ranks)], "<i4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each word. No word begins or ends with white space, so a piece that begins with a space begins a word."""
        known: dict[str, bytes] = {}
        out: list[list[bytes]] = []
        for p in split(" " + " ".join(words), self.pattern) if words else ():
            ids = known.get(p)
            if ids is None:
                ids = known[p] = np.array(merge(as_bytes(p), self.ranks), "<i4").tobytes()
            if p[0] == " ":
                out.append([ids])
            else:
                out[-1].append(ids)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def encode_texts(self, texts: pa.Array, uncut: Callable[[int], bytes] | None = None, apart: np.ndarray | None = None) -> Ids:
        return encode_texts(texts, self.memo, self.words, lambda some: [self.encode(t) for t in some], uncut, apart)

    def piece_counts(self, text: str) -> tuple[list[int], list[int]]:
        """(exclusive end of each piece in bytes, its number of tokens)."""
        ends, counts, at = [], [], 0
        for p in split(text, self.pattern):
            size = self.sizes.get(p)
            if size is None:
                raw = as_bytes(p)
                size = len(raw), len(merge(raw, self.ranks))
                self.sizes.put(p, size)
            at += size[0]
            ends.append(at)
            counts.append(size[1])
        return ends, counts


def pack(ends: list[int], counts: list[int], most: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of windows of whole pieces with at most ``most`` tokens; a larger piece stands alone; the next window
    begins as many whole pieces back as fit into ``overlap``, but after the window's first piece."""
    if most <= 0:
        raise ValueError("a window must hold at least one token")
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be at least 0 and smaller than the window")
    out, first, n = [], 0, len(counts)
    while first < n:
        stop, total = first, 0
        while stop < n and (stop == first or total + counts[stop] <= most):
            total += counts[stop]
            stop += 1
        out.append((ends[first - 1] if first else 0, ends[stop - 1], total))
        if stop == n:
            break
        back, shared = stop, 0
        while back - 1 > first and shared + counts[back - 1] <= overlap:
            back -= 1
            shared += counts[back]
        first = back
    return out
