"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived (an OR of ANDs that every match must satisfy). The index is a table
of postings: a row for each queried trigram and each text that holds it, texts known by their hash, sorted by trigram within files.
An AND takes the postings of its trigrams and intersects them: grouped by text, those stay that stand in every list. What any AND of
a rule leaves are the rule's candidates; they meet the texts again by hash, and only they meet the regex. A rule without a
mandatory trigram scans every text. Two texts with one hash share their postings, so they are candidates once too often at worst.

Spans count code points, end exclusive. Defined cases: null text counts as empty; a text without matches has empty lists; equal
rows are all kept; spans that begin at one place stand in the order of the rules; texts of any length are scanned whole; an empty
table gives an empty result; other columns are kept whatever their names, one named secret_spans is replaced. Letters in a rule
marked ``nocase`` match ASCII letters of either case.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    nocase: bool = False
    group: int = 0  #: whose length counts for ``least``
    least: int = 0  #: matches with fewer characters in the group are dropped, after matching

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.nocase else self.pattern


#: Maximal runs shorter than the least length can be left to the regex: no other match could begin inside of them.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", nocase=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
#: What redact() replaces: of a PEM key the base64 body, too, to its END line or, without one, as far as base64 goes on.
REDACTED = tuple(r if r.kind != "pem" else Rule("pem", r.pattern + r"(?:[A-Za-z0-9+/=\s:,.\\-]{0,20000}?-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{16,}){0,400}(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{1,76}={1,2})?)") for r in RULES)
MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings that a part of a parsed regex matches, lower-cased, if these are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                out.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 8:
                out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None
        return out
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] != C.MAXREPEAT and arg[1] <= 4:
        inner, out = _sequence(arg[2]), set()
        if inner is None:
            return None
        for n in range(arg[0], arg[1] + 1):
            out |= {"".join(x) for x in product(inner, repeat=n)}
        return out if len(out) <= MOST_STRINGS else None
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The OR of ANDs of lower-case trigrams that each match satisfies; empty: there is none, scan fully."""
    runs, now = [], {""}
    for node in parser.parse(pattern):
        part = _strings(node)
        if part is not None and len(now) * len(part) <= MOST_STRINGS:
            now = {a + b for a in now for b in part}
        else:
            runs.append(now)
            now = part if part is not None else {""}
            if part is None and node[0] in (C.MAX_REPEAT, C.MIN_REPEAT) and node[1][0] == 1:
                now = _sequence(node[1][2]) or {""}
                runs.append(now)
                now = {""}
    runs.append(now)
    best: list[frozenset[str]] = []
    for run in runs:
        ands = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in ands:
            continue
        ands = sorted((a for a in ands if not any(b < a for b in ands)), key=sorted)
        if not best or len(ands) < len(best) or len(ands) == len(best) and sum(map(len, ands)) > sum(map(len, best)):
            best = ands
    return best


class TrigramIndex:
    """Postings over the trigrams that some rule asks for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.queries = rules, {r.kind: trigram_query(r.pattern) for r in rules}
        self.trigrams = sorted({t for q in self.queries.values() for a in q for t in a})
        if len(rules) > 63 or any(len(a) > 63 for q in self.queries.values() for a in q):
            raise ValueError("more than 63 rules, or trigrams in one conjunction: scan in several passes")

    def postings(self, texts: DataFrame) -> DataFrame:
        """trigram, text_hash of texts (text_hash, text)."""
        low = texts.select("text_hash", F.lower("text").alias("low"))
        held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in self.trigrams)))
        return low.select(F.explode(held).alias("trigram"), "text_hash").sortWithinPartitions("trigram")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """text_hash, rules (bit i: rule i may match)."""
        asked = [(t, f"{r.kind}:{j}", 1 << k, (1 << len(ands)) - 1, 1 << i)
                 for i, r in enumerate(self.rules) for j, ands in enumerate(self.queries[r.kind]) for k, t in enumerate(sorted(ands))]
        queries = postings.sparkSession.createDataFrame(asked, "trigram string, query string, bit long, every long, rule long")
        lists = postings.where(F.col("trigram").isin(self.trigrams)).join(F.broadcast(queries), "trigram")  # as many rows as the rules have trigrams
        met = lists.groupBy("text_hash", "query", "every", "rule").agg(F.bit_or("bit").alias("got")).where("got = every")
        return met.groupBy("text_hash").agg(F.bit_or("rule").alias("rules"))


_SPANS = "array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>"
SPAN_BLOCK = 256  #: matches that are added up in one array at a time


def _spans(rule: Rule, order: int, text: Column, found: Column) -> Column:
    """Spans of the matches: the text between them tells where they stand. Lengths are added up within blocks of matches, then over
    the blocks."""
    sized = F.arrays_zip(
        F.transform(F.split(text, rule.java, -1), lambda x: F.length(x).cast("long")).alias("gap"),
        F.transform(found, lambda x: F.length(x).cast("long")).alias("len"),
        (F.transform(F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)), F.length) if rule.group else F.transform(found, F.length)).alias("part"),
    )
    sized = F.filter(sized, lambda x: x["len"].isNotNull())
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("kind_order"), (at + x["gap"] + x["len"]).alias("end"), F.lit(rule.kind).alias("kind"))
    none = F.array().cast(_SPANS)

    def block(k: Column) -> Column:
        return F.aggregate(
            F.slice(sized, k * SPAN_BLOCK + 1, SPAN_BLOCK),
            F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
            lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), F.when(x["part"] < rule.least, s["spans"]).otherwise(F.concat(s["spans"], F.array(span(s["at"], x)))).alias("spans")),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / SPAN_BLOCK).cast("int")), block)
    moved = lambda base, spans: F.transform(spans, lambda x: F.struct((base + x["start"]).alias("start"), x["kind_order"].alias("kind_order"), (base + x["end"]).alias("end"), x["kind"].alias("kind")))
    whole = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("parts")),
        lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["parts"], F.array(moved(s["at"], b["spans"]))).alias("parts")),
        lambda s: F.flatten(s["parts"]),
    )
    return F.when(F.size(found) > 0, whole).otherwise(none)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with secret_spans (sorted by start, then kind as listed), in place of a column of that name."""
    index, own = TrigramIndex(rules), "_scan"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    text = F.coalesce(text_col, F.lit(""))
    postings = Scratch(docs.sparkSession, "trigrams").cut(index.postings(docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))))
    candidates = index.candidates(postings).select(F.col("text_hash").alias(f"{own}_hash"), F.col("rules").alias(f"{own}_rules"))
    names = [c for c in docs.columns if c.lower() != "secret_spans"]
    out = docs.join(candidates, F.xxhash64(text) == F.col(f"{own}_hash"), "left")
    out = out.select(*names, F.struct(text.alias("text"), F.coalesce(f"{own}_rules", F.lit(0)).alias("rules")).alias(own))
    held, bits = F.col(f"{own}.text"), F.col(f"{own}.rules")
    meets = lambda i, r: bits.bitwiseAND(F.lit(1 << i).cast("long")) != 0 if index.queries[r.kind] else F.lit(True)
    found = [F.when(meets(i, r), F.regexp_extract_all(held, F.lit(r.java), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"f{i}") for i, r in enumerate(rules)]
    out = out.withColumn(own, F.struct(held.alias("text"), *found))
    spans = [_spans(r, i, held, F.col(f"{own}.f{i}")) for i, r in enumerate(rules)]
    return out.withColumn("secret_spans", F.array_sort(F.concat(*spans))).drop(own)


def render_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED) -> DataFrame:
    """docs with each stretch of text under a span replaced by ``[kind]`` (of the first span there), n_chars counted anew."""
    if clash := [c for c in docs.columns if c.lower() == "secret_spans"]:  # a column of the table: it stays
        return redact(docs.withColumnRenamed(clash[0], "_own_spans"), rules).withColumnRenamed("_own_spans", clash[0]).select(*docs.columns)
    found = find_secrets(docs, rules)
    part = "array<struct<start:bigint,len:bigint,kind:string>>"
    shown = lambda start, size: F.substring(F.col("text"), (start + 1).cast("int"), size.cast("int"))
    clean = F.aggregate(
        "secret_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(part).alias("parts")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["parts"]).otherwise(F.concat(s["parts"], F.array(F.struct(s["at"].alias("start"), (x["start"] - s["at"]).alias("len"), x["kind"].alias("kind"))))).alias("parts"),
        ),
        lambda s: F.concat(F.array_join(F.transform(s["parts"], lambda p: F.concat(shown(p["start"], p["len"]), F.lit("["), p["kind"], F.lit("]"))), ""), F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))),
    )
    found = found.withColumn("text", F.when(F.size("secret_spans") > 0, clean).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
