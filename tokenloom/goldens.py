"""Golden files: the bytes of every id, and ids and piece ends of fixed texts, as JSON lines that later versions are held against;
and a check that the patterns are still the published ones."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np

from tokenloom.functions.patterns import PATTERNS
from tokenloom.operators.kernel import Kernel
from tokenloom.sources.vocabulary import Vocabulary


def hazards() -> list[str]:
    """Texts at the edges of the patterns, made by rule: every white space, sign, digit, case and script beside each other."""
    space = ["", " ", "  ", "\n", "\r\n", " \n", "\n ", "\t", "\u00a0", "\u3000"]
    marks = ["a", "A", "\u00e9", "e\u0301", "\u4e2d", "1", "123", "1234", "\u0663", "'s", "'S", "'\u017f", "'ll", "'LL", ".", "...", "/", "\U0001f600", "<|endoftext|>", "\u02b0", "\u01c5", "\x00", "\x85"]
    pairs = [f"{a}{s}{b}" for a in marks for s in space for b in marks]
    runs = [c * n for c in (" ", "\n", "a", "1", "!", "\u4e2d") for n in (1, 2, 3, 4, 65, 1000)]
    return [*space, *marks, *pairs, *(f"{s}{m}{s}" for s in space for m in marks), *runs, "x" * 3000 + " y"]


def golden(v: Vocabulary, texts: Iterable[str]) -> Iterator[str]:
    """Lines: the encoding, one for each id (bytes in hex, null if not assigned), one for each text (ids, ends of its pieces)."""
    yield json.dumps({"encoding": v.encoding.name, "n_vocab": v.n_vocab})
    for i in range(v.n_vocab):
        raw = v.token_bytes.get(i)
        yield json.dumps({"id": i, "bytes": None if raw is None else raw.hex()})
    k = Kernel(v.ranks, v.encoding.pattern)
    for t in texts:
        yield json.dumps({"text": t, "ids": np.frombuffer(k.encode(t), "<i4").tolist(), "ends": k.piece_counts(t)[0]})


def write_golden(v: Vocabulary, path: str, texts: Iterable[str] | None = None) -> None:
    Path(path).write_text("".join(f"{line}\n" for line in golden(v, hazards() if texts is None else texts)))


def differences(v: Vocabulary, path: str) -> list[str]:
    """The lines of a golden file that the engine no longer gives."""
    was = Path(path).read_text().splitlines()
    now = golden(v, [x["text"] for line in was if "text" in (x := json.loads(line))])
    return [line for line, again in zip(was, now, strict=True) if json.loads(line) != json.loads(again)]


def published_patterns() -> dict[str, str] | None:
    """The patterns that the installed tiktoken package has, None without one. No vocabulary is loaded."""
    try:
        from tiktoken_ext import openai_public
    except ImportError:
        return None
    body = inspect.getsource(openai_public.o200k_base)
    listed = re.search(r"join\(\s*\[(.*?)\]\s*\)", body, re.S)
    cl100k = re.search(r'"pat_str":\s*r"""(.*?)"""', inspect.getsource(openai_public.cl100k_base), re.S)
    return {
        "gpt2": openai_public.r50k_pat_str if hasattr(openai_public, "r50k_pat_str") else "",
        "cl100k": cl100k[1] if cl100k else "",
        "o200k": "|".join(re.findall(r'r"""(.*?)"""', listed[1])) if listed else "",
    }


def drifted_patterns() -> list[str]:
    """Names of patterns that differ from those of the installed package."""
    published = published_patterns() or {}
    return [name for name, p in published.items() if p and p != PATTERNS[name]]
