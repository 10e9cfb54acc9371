"""The seven encodings: vocabulary file, pattern and special tokens in order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from tokenloom.errors import SpecialTokenError

# Names and ids of special tokens, here and below.
END_OF_TEXT = ("<|endoftext|>", 50256)
_FIM = ("<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>")


def _harmony() -> tuple[tuple[str, int], ...]:
    # The named tokens of this encoding. All other ids of the range are reserved.
    named = (
        ("<|startoftext|>", 199998), ("<|endoftext|>", 199999), ("<|return|>", 200002), ("<|constrain|>", 200003), ("<|channel|>", 200005),
        ("<|start|>", 200006), ("<|end|>", 200007), ("<|message|>", 200008), ("<|call|>", 200012), ("<|endofprompt|>", 200018),
    )
    taken = {i for _, i in named} - {200018}
    return named + tuple((f"<|reserved_{i}|>", i) for i in range(200000, 201088) if i not in taken)


class Registry:
    """Special tokens in the order of their addition: names are unique, ids need not be; the first name of an id decodes it."""

    def __init__(self, pairs: Iterable[tuple[str, int]] = ()):
        self.names: list[str] = []
        self.ids: list[int] = []
        self._index: dict[str, int] = {}
        for name, i in pairs:
            self.add(name, i)

    def add(self, name: str, i: int) -> None:
        if not name:
            raise SpecialTokenError("a special token needs a name")
        if i < 0:
            raise SpecialTokenError(f"the id {i} of {name!r} is negative")
        if name in self._index:
            raise SpecialTokenError(f"the special token {name!r} is there already")
        self._index[name] = len(self.names)
        self.names.append(name)
        self.ids.append(i)

    def __len__(self) -> int:
        return len(self.names)

    def __contains__(self, name: str) -> bool:
        return name in self._index

    def id_of(self, name: str) -> int:
        if name not in self._index:
            raise SpecialTokenError(f"unknown special token {name!r}")
        return self.ids[self._index[name]]

    def index_of_id(self, i: int) -> int:
        """The place of the first token with this id, -1 if there is none."""
        return self.ids.index(i) if i in self.ids else -1

    def name_at(self, index: int) -> str:
        if not 0 <= index < len(self.names):
            raise SpecialTokenError(f"place {index} is outside of 0..{len(self.names) - 1}")
        return self.names[index]

    def id_at(self, index: int) -> int:
        self.name_at(index)
        return self.ids[index]

    @property
    def highest_id(self) -> int:
        """-1 if there is no token."""
        return max(self.ids, default=-1)


@dataclass(frozen=True)
class Encoding:
    name: str
    vocabulary: str  #: stem of the vocabulary file
    pattern: str
    specials: tuple[tuple[str, int], ...]

    def __post_init__(self):
        Registry(self.specials)

    def registry(self) -> Registry:
        return Registry(self.specials)

    def special_ids(self) -> dict[str, int]:
        return dict(self.specials)

    def special_names(self) -> dict[int, str]:
        """id -> the first name that has it."""
        out: dict[int, str] = {}
        for name, i in self.specials:
            out.setdefault(i, name)
        return out


ENCODINGS = {
    e.name: e
    for e in (
        Encoding("gpt2", "r50k_base", "gpt2", (END_OF_TEXT,)),
        Encoding("r50k_base", "r50k_base", "gpt2", (END_OF_TEXT,)),
        Encoding("p50k_base", "p50k_base", "gpt2", (END_OF_TEXT,)),
        Encoding("p50k_edit", "p50k_base", "gpt2", (END_OF_TEXT, *zip(_FIM, range(50281, 50284), strict=True))),
        Encoding("cl100k_base", "cl100k_base", "cl100k", (("<|endoftext|>", 100257), *zip(_FIM, range(100258, 100261), strict=True), ("<|endofprompt|>", 100276))),
        Encoding("o200k_base", "o200k_base", "o200k", (("<|endoftext|>", 199999), ("<|endofprompt|>", 200018))),
        Encoding("o200k_harmony", "o200k_base", "o200k", _harmony()),
    )
}


def encoding(name: str) -> Encoding:
    if name not in ENCODINGS:
        raise ValueError(f"unknown encoding {name!r}; known: {', '.join(ENCODINGS)}")
    return ENCODINGS[name]
