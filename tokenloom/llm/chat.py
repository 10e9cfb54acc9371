"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Every rendered turn is parsed again by ``parse``; if what comes
back is not the source, its content is escaped and rendered anew. Escaping puts one more backslash between ``<`` and ``|``
(``<|`` -> ``<\\|``, ``<\\|`` -> ``<\\\\|``) and the parser always takes one away, so it can be undone whatever the text holds.

Defined cases: null text and null role count as empty; rows of a conversation stand in the order of turn (null first), equal
turns by role, then text, and equal rows are all kept; a null conversation id is a conversation of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end of the text as rendered) of each turn; None if the string is not in the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        stop = rendered.find(END, at)
        if line < 0 or stop < line or not rendered.startswith("\n", stop + len(END)):
            return None
        role, text = rendered[at + len(START) : line], rendered[line + 1 : stop]
        if START in role or START in text:
            return None
        turns.append((unescape(role.replace(BREAK, "\n")), unescape(text), line + 1, stop))
        at = stop + len(END) + 1
    return turns


def render(role: str, text: str) -> str:
    """The rendered turn: as it is if that parses back to the source, escaped otherwise."""
    for guard_role, guard_text in ((str, str), (str, escape), (lambda r: escape(r).replace("\n", BREAK), escape)):
        out = f"{START}{guard_role(role)}\n{guard_text(text)}{END}\n"
        back = parse(out)
        if back is not None and len(back) == 1 and back[0][:2] == (role, text):
            return out
    raise AssertionError("escaped turns always parse back")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, turn, role, text, rendered, loss_start, loss_end (code points in rendered)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rendered, starts, ends = [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                out = render(role, text)
                [(_, _, start, end)] = parse(out)
                rendered.append(out)
                starts.append(start if role == LOSS_ROLE else end)
                ends.append(end)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(rendered, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                [*b.schema.names, "rendered", "loss_start", "loss_end"],
            )

    kept = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"{n} {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(work, f"{kinds}, rendered string, loss_start long, loss_end long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: whole conversations as one string each, for those that fit one value."""
    parts = format_turns(turns).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered", "loss_start", "loss_end"))).alias("p")
    )
    offsets = F.aggregate(
        "p", F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>))"),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["rendered"])).alias("at"),
            F.when(x["loss_start"] < x["loss_end"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + x["loss_start"]).alias("start"), (s["at"] + x["loss_end"]).alias("end")))))
            .otherwise(s["spans"]).alias("spans"),
        ),
    )
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("formatted"), offsets["spans"].alias("loss_spans"))


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the formatted turns back, one conversation after the other; holds one turn and two running digests."""
    unset = object()
    key, state, done = unset, None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def close() -> None:
        n, turns, chars, loss, total = state
        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    for b in batches:
        for conv, rendered, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
            if conv != key:
                if state:
                    close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(rendered):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            spoken = unescape(rendered[start:end])
            state[2] += len(spoken)
            state[3].update(spoken.encode())
            state[4] += len(rendered)
        if len(done) >= 5000:
            yield flush()
    if state:
        close()
    if done:
        yield flush()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them by the parser.

    A digest is a sequential pass over one conversation, so its rows meet in one sorted stream, however many they are; that
    stream is never held as a whole.
    """
    rendered = format_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rendered.select("conv_id", "rendered", "loss_start", "loss_end").mapInArrow(_digest, _DIGESTS)
