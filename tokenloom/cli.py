"""Command line: count, encode, decode, vocab, completions. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import re
import sys

from tokenloom.encodings import ENCODINGS
from tokenloom.errors import SpecialTokenError
from tokenloom.operators.kernel import Kernel, as_text
from tokenloom.operators.text import policy, python_segments, quoted
from tokenloom.sources.vocabulary import Vocabulary


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tokenloom")
    p.add_argument("--version", action="version", version="tokenloom 0.1")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("count", "encode", "decode", "vocab"):
        s = sub.add_parser(name)
        s.add_argument("input", nargs="?")
        s.add_argument("--encoding", default="cl100k_base", choices=list(ENCODINGS))
        s.add_argument("--vocabulary")
        s.add_argument("--file")
        if name in ("count", "encode"):
            which = s.add_mutually_exclusive_group()
            which.add_argument("--allowed-special", action="append")
            which.add_argument("--strict-special", action="store_true")
        if name == "encode":
            s.add_argument("--format", default="space", choices=("space", "lines", "json"))
    s = sub.add_parser("completions")
    s.add_argument("shell", choices=SHELLS)
    return p


SHELLS = ("bash", "zsh", "fish")


def completions(shell: str) -> str:
    """A completion script, derived from the parser."""
    commands = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    options = {name: [(a.option_strings[-1], [str(c) for c in a.choices or ()]) for a in c._actions if a.option_strings] for name, c in commands.items()}
    if shell == "fish":
        lines = [f"complete -c tokenloom -f -n __fish_use_subcommand -a {name}" for name in commands]
        for name, known in options.items():
            lines += [f"complete -c tokenloom -n '__fish_seen_subcommand_from {name}' -l {o[2:]}" + (f" -x -a '{' '.join(values)}'" if values else "") for o, values in known if o.startswith("--")]
        return "\n".join(lines) + "\n"
    cases = "".join(f"        {o}) COMPREPLY=($(compgen -W '{' '.join(values)}' -- \"$cur\")); return;;\n" for o, values in sorted({(o, tuple(v)) for known in options.values() for o, v in known if v}))
    words = "".join(f"        {name}) COMPREPLY=($(compgen -W '{' '.join(o for o, _ in known)}' -- \"$cur\")); return;;\n" for name, known in options.items())
    script = (
        "_tokenloom() {\n    local cur=${COMP_WORDS[COMP_CWORD]} before=${COMP_WORDS[COMP_CWORD-1]}\n    case $before in\n" + cases + "    esac\n    case ${COMP_WORDS[1]} in\n" + words
        + f"    esac\n    COMPREPLY=($(compgen -W '{' '.join(commands)}' -- \"$cur\"))\n}}\ncomplete -o default -F _tokenloom tokenloom\n"
    )
    return ("autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else "") + script


def _input(args, stdin) -> bytes:
    if args.input is not None:
        return args.input.encode("utf-8", "surrogateescape")
    if args.file:
        with open(args.file, "rb") as f:
            return f.read()
    if stdin.isatty():
        raise ValueError("no input: give text, --file or a pipe")
    return stdin.buffer.read()


def _ids(args, v: Vocabulary, raw: bytes) -> list[int]:
    import numpy as np

    text, allowed = as_text(raw), args.allowed_special or []
    names, refused = policy(v.encoding, allowed)
    if (allowed or args.strict_special) and refused and (hit := re.search(quoted(refused), text)):
        raise SpecialTokenError(f"the text holds the special token {hit[0]}, which is not allowed")
    k = Kernel(v.ranks, v.encoding.pattern)
    out: list[int] = []
    for s, i in python_segments(text, names, v.encoding.special_ids()):
        out += np.frombuffer(k.encode(s), "<i4").tolist() if i is None else [i]
    return out


def main(argv: list[str] | None = None, stdin=sys.stdin, stdout=sys.stdout) -> int:
    args = parser().parse_args(argv)
    if args.command == "completions":
        stdout.write(completions(args.shell))
        return 0
    try:
        v = Vocabulary.load(args.encoding, args.vocabulary)
        if args.command == "vocab":
            if args.input is not None:
                i = v.ranks.get(args.input.encode())
                stdout.write(f"{args.input!r} is " + (f"token {i}\n" if i is not None else "not one token\n"))
            else:
                stdout.write(f"encoding {args.encoding}\nn_vocab {v.n_vocab}\nmerge tokens {v.merge_count}\nranks {len(v.ranks)}\n" + "".join(f"{n} {i}\n" for n, i in v.encoding.specials))
            return 0
        raw = _input(args, stdin)
        if args.command == "decode":
            ids = [int(x) for x in re.findall(rb"[0-9]+", raw)]
            if not ids:
                raise ValueError("no token ids in the input")
            for i in ids:
                v.check_id(i)
            stdout.flush()
            stdout.buffer.write(b"".join(v.token_bytes[i] for i in ids))
        elif args.command == "count":
            stdout.write(f"{len(_ids(args, v, raw))}\n")
        else:
            ids = _ids(args, v, raw)
            stdout.write({"space": " ".join, "lines": "\n".join, "json": lambda x: "[" + ",".join(x) + "]"}[args.format](list(map(str, ids))))
        return 0
    except (ValueError, OSError) as e:
        sys.stderr.write(f"tokenloom: {e}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main())
