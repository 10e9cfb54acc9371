"""The three pre-tokenization patterns, and what they need to mean the same on the JVM, in Python and in DuckDB.

The classes are Unicode 16.0's. The JVM's tables are older: a text with a code point that the JVM doesn't know is split in Python.
Python's regex module is newer: code points that came later are masked there.
"""

from __future__ import annotations

import regex

# The published patterns of the encodings.
CL100K = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
O200K = "|".join([
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
    r"\p{N}{1,3}", r" ?[^\s\p{L}\p{N}]+[\r\n/]*", r"\s*[\r\n]+", r"\s+(?!\S)", r"\s+",
])
GPT2 = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PATTERNS = {"cl100k": CL100K, "o200k": O200K, "gpt2": GPT2}

#: Code points that are letters, marks or numbers in later versions of Unicode than 16.0 only.
LATER = (
    "558 58b-58c 5c8-5c9 88f b53-b54 c5c cdc 1acf-1af0 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ecb-10ecf 10ed9-10eee 10ef0-10efb 11b0a 11b60-11b67 11db0-11ddb 11de0-11de9 11df0-11df1 1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d127-1d128 "
    "1d250-1d252 1d25b-1d25c 1d25f 1d280-1d281 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6f5 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_LATER = regex.compile("[" + "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split()) + "]")
#: U+0295 was a lower-case letter in 16.0 and has no case later.
_GLOTTAL, _LOWER = "ʕ", "ɐ"
MASK = chr(0xE000)


def java_pattern(name: str) -> str:
    """For Java: Unicode classes, the end of the input alone as ``$``, case folding beyond ASCII."""
    return "(?U)" + PATTERNS[name].replace("$", r"\z").replace("(?i:", "(?iu:")


_compiled = {name: regex.compile(p.replace("$", r"\Z")) for name, p in PATTERNS.items()}


def split(text: str, name: str) -> list[str]:
    """The pieces of a text; bytes that aren't UTF-8 stand in it as lone surrogates and count as punctuation, one by one."""
    if text.isascii() or not (_LATER.search(text) or _GLOTTAL in text):
        return _compiled[name].findall(text)
    out, at = [], 0
    for piece in _compiled[name].findall(_LATER.sub(MASK, text).replace(_GLOTTAL, _LOWER)):
        out.append(text[at : at + len(piece)])
        at += len(piece)
    return out
