"""Byte-level BPE encoding by speculation: greedy longest match proposes, pair checks verify, exact merging repairs.

A sequence of tokens is what the merge loop makes of their bytes if, and only if, each token is what it makes of its own bytes
and no two neighbours would have merged across their boundary at any time. The second is decided by walking both tokens' merge
trees backwards in time along the boundary. That walk runs in numpy on all proposed pairs of a batch at once. Words that fail go
through the merge loop itself.

Defined cases: null text counts as empty; empty text has no tokens; repeated rows are all kept; a text or word of any length is
encoded whole (the merge loop is a heap), words of more than MEMO_WORD characters are not remembered; other columns are untouched,
those named like an added one are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tokenloom.llm import caches
from tokenloom.operators.batch import Memo, encode_texts, groups, stretches

#: The split pattern of byte-level tokenizers of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Of words and of pieces, of at most MEMO_WORD characters; some 170 bytes each with their ids, so some 27 MB for a worker.
MEMO_ENTRIES, MEMO_WORD = 80_000, 64
LEAST_TIMES = 2  #: a word that occurs once in a group of texts is not remembered
ID_BITS = 24  #: of a merge's value: its rank above, the token that it makes below
LOW_BITS = (1 << ID_BITS) - 1
SCAN = 32  #: bytes up to which the merge loop scans a list
NEVER = np.int64(1) << 40
#: Code points that this regex module calls letters, marks or numbers and the tokenizers library does not yet.
LATER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    "\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in tokenizer files: itself if visible Latin-1, else the next code point from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tables(spec: bytes) -> dict:
    """What a codec needs of a tokenizers file with a ByteLevel pre-tokenizer, BPE model and added tokens, in a few arrays."""
    d = json.loads(spec)
    model, alphabet = d["model"], byte_alphabet()
    special = {x["content"]: x["id"] for x in d["added_tokens"]}
    bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if t not in special}
    n = max([*bytes_of, *special.values()]) + 1
    token = [bytes_of.get(i) for i in range(n)]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    left, right, rank = (np.full(n, -1, np.int64) for _ in range(3))
    left[pairs[::-1, 2]], right[pairs[::-1, 2]], rank[pairs[::-1, 2]] = pairs[::-1, 0], pairs[::-1, 1], np.arange(len(pairs))[::-1]
    edges: dict[int, int] = {}  # a trie of the tokens: node and byte -> node
    ends = {}
    for i, t in enumerate(token):
        node = 0
        for b in t or b"":
            node = edges.setdefault(node << 8 | b, len(edges) + 1)
        ends[node] = i if t else -1
    keys = np.array(list(edges), np.int64)
    order, stops = np.argsort(keys), np.full(len(edges) + 1, -1, np.int64)
    stops[list(ends)] = list(ends.values())
    stops[0] = -1
    trie = {"edge": keys[order], "node": np.array(list(edges.values()), np.int64)[order], "stop": stops}
    return trie | {"special": special, "token": b"".join(t or b"" for t in token), "size": np.array([-1 if t is None else len(t) for t in token], np.int32), "pairs": pairs, "left": left, "right": right, "rank": rank}


class Codec:
    """An encoder and decoder from tables(); they are small, as every Python worker holds one."""

    def __init__(self, t: dict, memo_entries: int = MEMO_ENTRIES):
        self.special = t["special"]
        width = t["size"].astype(np.int64)
        n = self.size = len(width)
        ends = np.cumsum(np.maximum(width, 0)).tolist()
        numbers = list(range(n))
        self.id_of = {t["token"][e - w : e]: i for i, w, e in zip(numbers, width.tolist(), ends, strict=True) if w >= 0}
        self.left, self.right, self.rank = t["left"], t["right"], t["rank"]
        self.edge, self.node, self.stop = t["edge"], t["node"], t["stop"]
        self.first = np.zeros(256, np.int64)  # the nodes of single bytes
        self.first[self.edge[self.edge < 256]] = self.node[self.edge < 256]
        pairs = t["pairs"]
        self.merges = {(numbers[a], numbers[b]): r << ID_BITS | c for r, (a, b, c) in enumerate(pairs.tolist())}
        keys = pairs[:, 0] * n + pairs[:, 1]
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], order.astype(np.int64)
        self.byte_id = [self.id_of.get(bytes([b]), -1) for b in range(256)]
        self.longest: dict[bytes, int] = {}  # of the tokens that begin with these three bytes, or are these one or two
        for b in self.id_of:
            self.longest[b[:3]] = max(self.longest.get(b[:3], 0), len(b))
        if "whole" in t:
            self.whole = t["whole"]
        else:
            made = np.flatnonzero(self.rank >= 0)
            self.whole = np.ones(n, bool)
            fine = self.apart(self.left[made], self.right[made], self.rank[made])
            for c, ok in sorted(zip(made.tolist(), fine.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
                self.whole[c] = ok and self.whole[self.left[c]] and self.whole[self.right[c]]
            t["whole"] = self.whole
        self.memo, self.memo_pieces = Memo(memo_entries, MEMO_WORD, LEAST_TIMES), Memo(memo_entries, MEMO_WORD)
        self.split = regex.compile(SPLIT).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        names = {i: s.encode() for s, i in self.special.items()}
        tokens = [names.get(i, t["token"][e - max(w, 0) : e]) for i, w, e in zip(numbers, width.tolist(), ends, strict=True)]
        self.flat, self.width = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(x) for x in tokens], np.int64)
        self.begin = np.cumsum(self.width) - self.width

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as f:
            return cls(tables(f.read()))

    def pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def apart(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: nothing merges across their boundary before rank ``until`` (by default, ever).

        x and y stand for what touches the boundary from either side at some time; they go back to their inner child when that
        was made last. A pair merges across if its rank comes before both parts are used up; at the same rank the left one of
        two overlapping merges goes first.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        end = np.full(len(x), NEVER) if until is None else until.astype(np.int64)
        ends_x, ends_y, result = end.copy(), end.copy() - (until is not None), np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            m = self.pair_ranks(x, y)
            crossed = (m < ends_x) & (m <= ends_y)
            result[live[crossed]] = False
            go = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y, ends_x, ends_y = live[go], x[go], y[go], ends_x[go], ends_y[go]
            back = self.rank[x] > self.rank[y]
            ends_x, ends_y = np.where(back, self.rank[x], ends_x), np.where(back, ends_y, self.rank[y])
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return result

    def propose(self, word: bytes) -> list[int]:
        out, at, n, get, longest = [], 0, len(word), self.id_of.get, self.longest.get
        while at < n:
            to = min(n, at + longest(word[at : at + 3], 2))
            while (t := get(word[at:to])) is None:
                to -= 1
            out.append(t)
            at = to
        return out

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each): the same for many short words, which walk the trie together, a byte a step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        word, begin, stop = np.flatnonzero(size), (ends - size)[size > 0], ends[size > 0]
        at, node = begin + 1, self.first[raw[begin]]
        best, best_end = self.stop[node], at
        out: list[tuple[np.ndarray, ...]] = []
        while len(word):
            open_ = at < stop
            key = node << 8 | raw[np.minimum(at, stop - 1)]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            goes = open_ & (self.edge[edge] == key)
            node = np.where(goes, self.node[edge], node)
            at = at + goes
            token = self.stop[node]
            longer = goes & (token >= 0)
            best, best_end = np.where(longer, token, best), np.where(longer, at, best_end)
            ended = np.flatnonzero(~goes)
            if len(ended):
                out.append((word[ended], begin[ended], best[ended]))
                begin[ended] = best_end[ended]
                fresh = ended[begin[ended] < stop[ended]]
                at[fresh], node[fresh] = begin[fresh] + 1, self.first[raw[begin[fresh]]]
                best[fresh], best_end[fresh] = self.stop[node[fresh]], at[fresh]
                live = begin < stop
                if not live.all():
                    word, begin, stop, at, node, best, best_end = (x[live] for x in (word, begin, stop, at, node, best, best_end))
        if not out:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, begin, token = (np.concatenate(x) for x in zip(*out, strict=True))
        return token[np.argsort(begin)], np.bincount(word, minlength=len(words))

    def exact(self, word: bytes) -> list[int]:
        """The merge loop: always the lowest rank, the leftmost of equals."""
        ids = [self.byte_id[b] for b in word]
        return self._scan(ids) if len(ids) <= SCAN else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, 1 << 62
        pairs = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            made = low & LOW_BITS
            ids[i : i + 2] = [made]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get((made, ids[i + 1]), none)
            if i:
                pairs[i - 1] = get((ids[i - 1], made), none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for words of any length."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            c = m & LOW_BITS
            ids[i], ids[j], k = c, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (m := get((c, ids[k]))) is not None:
                    heapq.heappush(heap, (m, i, c, ids[k]))
            if (p := before[i]) >= 0 and (m := get((ids[p], c))) is not None:
                heapq.heappush(heap, (m, p, ids[p], c))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian bytes, of words not met before."""
        raw = [w.encode() for w in words]
        if max(map(len, raw), default=0) <= 4 * MEMO_WORD:
            flat, lengths = self.propose_all(raw)
        else:  # as many steps as the longest has bytes
            proposed = [self.propose(b) for b in raw]
            lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
            flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.whole[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            key, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            bad[owner[inner[~self.apart(key // self.size, key % self.size)[back]]]] = True
        packed, ends = flat.astype("<u4").tobytes(), (np.cumsum(lengths) * 4).tolist()
        found = {w: packed[a:b] for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}
        for i in np.flatnonzero(bad).tolist():
            found[words[i]] = np.array(self.exact(raw[i]), "<u4").tobytes()
        return found

    def pieces(self, text: str) -> list[str]:
        if not text.isascii() and LATER.search(text):
            out, at = [], 0
            for piece in self.split(LATER.sub("\ue000", text)):
                out.append(text[at : at + len(piece)])
                at += len(piece)
            return out
        return self.split(text)

    def know(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of the distinct pieces among these; words that differ in a comma share theirs."""
        kinds = list(set(pieces))

        def make(new: list[str]) -> list[bytes]:
            found: dict[str, bytes] = {}
            for some in ([x for x in new if len(x) <= MEMO_WORD], [x for x in new if len(x) > MEMO_WORD]):
                for i in range(0, len(some), 50_000):
                    found |= self.learn(some[i : i + 50_000])
            return [found[x] for x in new]

        return dict(zip(kinds, self.memo_pieces.look_up(kinds, np.ones(len(kinds), np.int64), make), strict=True))

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each word. No word begins or ends with white space, so a piece that begins with a space begins a word."""
        pieces = self.pieces(" " + " ".join(words)) if words else []
        found = self.know(pieces)
        out: list[list[bytes]] = []
        for p in pieces:
            if p[0] == " ":
                out.append([found[p]])
            else:
                out[-1].append(found[p])
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def text_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, piece by piece, special tokens where they stand."""
        cut = [self.special_split.split(t) if self.special_split else [t] for t in texts]
        pieces = [[[x] if x in self.special else self.pieces(x) for x in parts] for parts in cut]
        found = self.know([p for parts in pieces for x in parts for p in x if p not in self.special])
        found |= {s: i.to_bytes(4, "little") for s, i in self.special.items()}
        return [b"".join(found[p] for x in parts for p in x) for parts in pieces]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end)."""
        apart = np.zeros(len(texts), bool)
        for s in self.special:
            apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        ids = encode_texts(texts, self.memo, self.words_ids, self.text_ids, apart=apart)
        return ids.ids(), np.cumsum(ids.counts())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        ids, ends = self.encode_texts(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]

    def decode_texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each stretch of ids; what isn't UTF-8 is replaced."""
        raw = self.flat[stretches(self.begin[ids], self.width[ids])].tobytes()
        at = np.concatenate([[0], np.cumsum(self.width[ids])])[np.concatenate([[0], ends])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


_codecs: dict[str, Codec] = {}


def codec_of(key: str, packed: dict) -> Codec:
    """One codec per Python worker and file, with its memos, which are bounded; its tasks share it, until other work begins there."""
    if key not in _codecs:
        _codecs[key] = Codec(packed)
    return _codecs[key]


#: Bytes of text that are encoded together.
GROUP_BYTES = 1_000_000


def _listed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


def _map(df: DataFrame, text_col: str, path: str, extra: str, names: list[str], columns, drop: bool = False) -> DataFrame:
    """df, without the text if ``drop``, with more columns: columns(codec, ids, ends, texts) for each group of texts."""
    with open(path, "rb") as f:
        spec = f.read()
    key, packed = hashlib.sha256(spec).hexdigest(), tables(spec)
    packed["whole"] = Codec(packed).whole
    shared = df.sparkSession.sparkContext.broadcast(packed)  # one vocabulary: of a fixed size
    kept = [c for c in df.columns if not (drop and c == text_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("bpe", _codecs.clear)
        codec = codec_of(key, shared.value)
        for b in batches:
            start = 0
            for texts in groups(b.column(text_col), GROUP_BYTES):
                part = b.slice(start, len(texts)).select(kept)
                start += len(texts)
                texts = pc.fill_null(texts, "")
                yield pa.RecordBatch.from_arrays([*part.columns, *columns(codec, *codec.encode_texts(texts), texts)], [*kept, *names])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema.fields)
    return df.mapInArrow(work, kinds + extra)


def encode_decode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds token_ids (array<int>), n_tokens and decoded to the columns of df, in place of any of these names."""

    def columns(c: Codec, ids: np.ndarray, ends: np.ndarray, _) -> list[pa.Array]:
        return [_listed(ids, ends), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(c.decode_texts(ids, ends), pa.string())]

    return _map(df.drop("token_ids", "n_tokens", "decoded"), text_col, path, "token_ids array<int>, n_tokens long, decoded string", ["token_ids", "n_tokens", "decoded"], columns)


def encoded(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df without text_col, with token_ids, n_tokens and round_trips (decoding gives the text back, null as empty) in place of any of
    these names; neither text nor decoded text comes back from the worker."""

    def columns(c: Codec, ids: np.ndarray, ends: np.ndarray, texts: pa.Array) -> list[pa.Array]:
        same = [a == b for a, b in zip(c.decode_texts(ids, ends), texts.to_pylist(), strict=True)]
        return [_listed(ids, ends), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(same, pa.bool_())]

    new = ["token_ids", "n_tokens", "round_trips"]
    return _map(df.drop(*new), text_col, path, "token_ids array<int>, n_tokens long, round_trips boolean", new, columns, drop=True)


def digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and decoded text never leave the worker."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def columns(c: Codec, ids: np.ndarray, ends: np.ndarray, _) -> list[pa.Array]:
        raw = memoryview(ids.astype("<u4").tobytes())
        own = [sha(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return [pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(own, pa.string()), pa.array([sha(t.encode()) for t in c.decode_texts(ids, ends)], pa.string())]

    return _map(df.select("doc_id", text_col), text_col, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], columns, drop=True)
