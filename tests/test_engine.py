"""The engine against an independent tokenizer, its own definitions and small cases."""

import base64
import io

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom import cli, goldens
from tokenloom.encodings import ENCODINGS, Registry
from tokenloom.errors import SpecialTokenError, TokenError, VocabularyError
from tokenloom.functions.patterns import CL100K, GPT2, O200K, split
from tokenloom.operators import text as T
from tokenloom.operators import tokens
from tokenloom.operators.batch import Memo
from tokenloom.operators.kernel import Kernel, merge, pack
from tokenloom.plans.tokenizer import Tokenizer
from tokenloom.sources.vocabulary import Vocabulary, candidates, parse_ranks, read_ranks

HARD = ["", " ", "\n", "hello world", "don't 'S stop", "1234567890", "a\r\nb\n\nc", "  leading and trailing   ", "café naïve 中文 😀 🚀", "áb", "x" * 3000, "\n  b", "Ᲊ࢏ ՘", "ʕʔ A", "<|endoftext|>", "\x1c\x85 　x"]
R50K = Vocabulary.load("gpt2")


def oracle(pattern):
    return tiktoken.Encoding("o", pat_str=pattern, mergeable_ranks=R50K.ranks, special_tokens={})


@pytest.mark.parametrize("name, pattern", [("gpt2", GPT2), ("cl100k", CL100K), ("o200k", O200K)])
def test_ids_equal_tiktoken(name, pattern):
    k, o = Kernel(R50K.ranks, name), oracle(pattern)
    for t in HARD:
        assert np.frombuffer(k.encode(t), "<i4").tolist() == o.encode_ordinary(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aABst'é中 \n\r\t1٣_/-😀", max_size=60))
def test_generated_ids_equal_tiktoken(t):
    for name, pattern in (("gpt2", GPT2), ("cl100k", CL100K), ("o200k", O200K)):
        assert np.frombuffer(Kernel(R50K.ranks, name).encode(t), "<i4").tolist() == oracle(pattern).encode_ordinary(t)


def test_merge_order_and_long_pieces():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    for piece, ids in ((b"abc", [258]), (b"ca", [99, 97]), (b"cab", [99, 256]), (b"abca", [258, 97]), (b"", [])):
        assert merge(piece, ranks) == ids
    assert merge(b"abca" * 100, ranks) == [258, 97] * 100


@pytest.mark.parametrize("raw", [b"", b"YQ==", b"YQ== 0 x", b"not!base64 0", b"YQ== zero", b"YQ== -1", b"YQ== 0\nYg== 0"])
def test_bad_vocabularies(raw):
    with pytest.raises(VocabularyError):
        parse_ranks(raw)


def test_vocabulary_sizes():
    assert [(Vocabulary.load(n).n_vocab, Vocabulary.load(n).merge_count) for n in ("gpt2", "p50k_base", "p50k_edit")] == [(50257, 50256), (50281, 50281), (50284, 50281)]
    assert len(ENCODINGS["o200k_harmony"].specials) == 1091 and len(set(dict(ENCODINGS["o200k_harmony"].specials).values())) == 1090


def test_jvm_pieces_equal_python_pieces(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "i int, t string")
    for p in ("gpt2", "cl100k", "o200k"):
        for r in d.withColumn("p", T.pieces(F.col("t"), p)).collect():
            assert list(r.p) == split(r.t, p), (p, r.t)


def test_encode_decode_and_nulls(spark):
    t = Tokenizer.load(spark, "gpt2")
    d = spark.createDataFrame([*((i, x) for i, x in enumerate(HARD)), (99, None)], "doc_id int, text string")
    back = {r.doc_id: r.text for r in t.decode(t.encode_ordinary(d).select("doc_id", "ids")).collect()}
    assert back == dict(enumerate(HARD)) | {99: None}
    raw = spark.createDataFrame([(bytearray(x),) for x in (b"\xc3", b"\x80\x81", b"\xed\xa0\x80", b"A\xffB\xfe", bytes(range(256)))], "text binary")
    for r in t.decode_bytes(t.encode_ordinary(raw)).collect():
        assert r.bytes == r.text


def test_special_tokens(spark):
    t = Tokenizer.load(spark, "gpt2")
    d = spark.createDataFrame([("a <|endoftext|> b",)], "text string")
    assert 50256 in t.encode(d, allowed=["<|endoftext|>"]).first().ids
    assert 50256 not in t.encode_ordinary(d).first().ids
    with pytest.raises(Exception, match="not allowed"):
        t.encode(d).collect()
    with pytest.raises(SpecialTokenError):
        t.encode(d, allowed=["<|nope|>"])


def test_windows_truncate_pad(spark):
    t = Tokenizer.load(spark, "gpt2")
    d = spark.createDataFrame([(0, "hello"), (1, ""), (2, "a long one, two words and more " * 5)], "doc_id int, text string")
    for r in t.windows(d, 7, 2).collect():
        raw = r.text.encode()
        assert (not raw and not r.windows) or (r.windows[0].start == 0 and r.windows[-1].end == len(raw))
    with pytest.raises(ValueError):
        pack([], [], 0)
    with pytest.raises(ValueError):
        pack([], [], 4, 4)
    cuts = {r.doc_id: r.cut for r in t.truncate(d, 5).collect()}
    assert cuts[0] == 5 and cuts[1] == 0 and 0 < cuts[2] < 150
    p = t.pad(d, 0, 4).collect()
    assert all(len(r.ids) == len(r.mask) == r.width == 4 and sum(r.mask) == r.length for r in p)
    with pytest.raises(TokenError):
        t.pad(d, 50257)
    assert [(r.start, r.end) for r in tokens.batch_offsets(t.count_ordinary(d)).orderBy("doc_id").collect()][:2] == [(0, 1), (1, 1)]


def test_sql_functions_and_stream(spark, tmp_path):
    t = Tokenizer.load(spark, "gpt2")
    t.register()
    assert spark.sql("select gpt2_count('hello world') n").first().n == 2
    from tokenloom.streaming import token_rate

    spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'hello world' text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = token_rate(stream, t.vocabulary, "text", "ts", "1 minute", "1 minute").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rates").first().n_tokens == 2


def test_no_cartesian_product_and_pruned_scan(spark, tmp_path):
    spark.range(5).selectExpr("id doc_id", "'a b' text", "'x' lang", "'y' unused").write.parquet(str(tmp_path / "documents.parquet"))
    from tokenloom.plans.queries import tokens_by_lang_source  # noqa: F401

    plan = Tokenizer.load(spark, "gpt2").count_ordinary(spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "Cartesian" not in plan


class _Out(io.TextIOWrapper):
    def __init__(self):
        super().__init__(io.BytesIO(), write_through=True)

    def value(self):
        return self.buffer.getvalue().decode()


@pytest.mark.parametrize("argv, code, out", [
    (["count", "hello world", "--encoding", "gpt2"], 0, "2\n"), (["encode", "hello world", "--encoding", "gpt2", "--format", "json"], 0, "[31373,995]"),
    (["decode", "31373 995", "--encoding", "gpt2"], 0, "hello world"), (["decode", "none", "--encoding", "gpt2"], 1, ""), (["encode", "<|endoftext|>", "--encoding", "gpt2", "--strict-special"], 1, ""),
])
def test_cli(argv, code, out):
    o = _Out()
    assert cli.main(argv, stdout=o) == code and o.value() == out


@pytest.mark.parametrize("shell", cli.SHELLS)
def test_completions(shell):
    o = _Out()
    assert cli.main(["completions", shell], stdout=o) == 0 and all(x in o.value() for x in ("count", "encode", "allowed-special", "o200k_harmony"))


def test_cli_input_and_vocabulary(tmp_path):
    (tmp_path / "t").write_bytes(b"hello\r\nworld")
    o = _Out()
    assert cli.main(["encode", "--file", str(tmp_path / "t"), "--encoding", "gpt2", "--format", "lines"], stdout=o) == 0
    assert bytes.fromhex("").join(R50K.token_bytes[int(i)] for i in o.value().split("\n")) == b"hello\r\nworld"
    pipe = io.TextIOWrapper(io.BytesIO(b"hello world"))
    for argv, out in ((["count", "--encoding", "gpt2"], "2\n"), (["vocab", "hello", "--encoding", "gpt2"], "'hello' is token 31373\n"), (["vocab", "hello world x", "--encoding", "gpt2"], "'hello world x' is not one token\n")):
        o = _Out()
        assert cli.main(argv, stdin=pipe, stdout=o) == 0 and o.value() == out
    o = _Out()
    assert cli.main(["vocab", "--encoding", "p50k_edit"], stdout=o) == 0 and "n_vocab 50284" in o.value() and "<|fim_suffix|> 50283" in o.value()
    with pytest.raises(SystemExit) as e:
        cli.main(["encode", "x", "--allowed-special", "<|endoftext|>", "--strict-special"])
    assert e.value.code == 2


def test_registry():
    r = Registry([("<a>", 7), ("<b>", 7)])
    assert (len(r), r.id_of("<b>"), r.index_of_id(7), r.index_of_id(8), r.name_at(1), r.id_at(0), r.highest_id, Registry().highest_id) == (2, 7, 0, -1, "<b>", 7, 7, -1)
    for bad in (lambda: r.add("<a>", 9), lambda: r.add("", 9), lambda: r.add("<c>", -1), lambda: r.id_of("<c>"), lambda: r.name_at(2), lambda: r.id_at(-1)):
        with pytest.raises(SpecialTokenError):
            bad()
    assert ENCODINGS["o200k_harmony"].special_names()[200018] == "<|endofprompt|>"


def test_candidates(monkeypatch, tmp_path):
    monkeypatch.setenv("TOKENLOOM_VOCAB_DIR", str(tmp_path))
    assert candidates("x", "/own/file") == ["/own/file"] and candidates("cl100k_base")[0] == f"{tmp_path}/cl100k_base.tiktoken"
    with pytest.raises(VocabularyError, match="looked at"):
        Vocabulary.load("o200k_base")


def ranks_file(path, tokens):
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))


@pytest.mark.parametrize("name, size", [("cl100k_base", 100257), ("o200k_base", 199998), ("o200k_harmony", 199998)])
def test_large_encodings_from_a_file(spark, monkeypatch, tmp_path, name, size):
    """The real files aren't on this machine: one of the same size, with all bytes, some merges and tokens that nothing makes."""
    tokens_ = [bytes([b]) for b in range(256)] + [b"he", b"ll", b"hell", b"hello", b" w", b"or", b" wor"]
    ranks_file(tmp_path / f"{name.replace('harmony', 'base')}.tiktoken", tokens_ + [b"\xff\xff%d" % i for i in range(size - len(tokens_))])
    monkeypatch.setenv("TOKENLOOM_VOCAB_DIR", str(tmp_path))
    t = Tokenizer.load(spark, name)
    special = t.vocabulary.encoding.specials[0]
    d = spark.createDataFrame([(f"hello wor{special[0]}12",)], "text string")
    assert t.encode(d, allowed=[special[0]]).first().ids == [259, 262, special[1], 49, 50]
    assert t.vocabulary.merge_count == size and t.n_vocab == max(i for _, i in t.vocabulary.encoding.specials) + 1
    assert read_ranks(spark, str(tmp_path / f"{name.replace('harmony', 'base')}.tiktoken")).count() == size


def test_read_ranks_refuses_what_the_loader_refuses(spark, tmp_path):
    for k, raw in enumerate((b"\n", b"YQ==\n", b"YQ== 0 x\n", b"not!base64 0\n", b"YQ== zero\n", b"YQ== -1\n", b"YQ== 0\nYg== 0\n")):
        (tmp_path / str(k)).write_bytes(raw)
        with pytest.raises(VocabularyError):
            read_ranks(spark, str(tmp_path / str(k)))


def test_malformed_bytes_beside_special_tokens(spark):
    t = Tokenizer.load(spark, "gpt2")
    raw = [b"A\xff<|endoftext|>\xfe", b"<|endoftext|>", b"\xc3<|endof", b"plain words here", None]
    d = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(raw)], "i int, text binary").repartition(2)
    out = t.decode_bytes(t.encode(d, allowed=["<|endoftext|>"])).orderBy("i").collect()
    assert [None if r.bytes is None else bytes(r.bytes) for r in out] == raw and 50256 in out[0].ids and out[1].ids == [50256]
    assert [r.n_tokens for r in t.count(d, allowed=["<|endoftext|>"]).orderBy("i").collect()] == [r.n_tokens for r in out]
    with pytest.raises(Exception, match="not allowed"):
        t.encode(d).collect()


def test_pieces_beyond_the_jvm_in_every_operator(spark):
    text = "a\U00016d40b c"  # a letter that the JVM doesn't know
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    want = split(text, "gpt2")
    assert {r.piece for r in tokens.piece_frequency(d, "gpt2").collect()} == set(want)
    assert [r.end for r in T.piece_ends(d, "gpt2").orderBy("piece_ix").collect()] == [len("".join(want[: k + 1]).encode()) for k in range(len(want))]


def test_memo():
    m = Memo(2, 3)
    assert m.get("a") is None and m.put("a", b"1") and m.get("a") == b"1" and not m.put("long", b"2") and m.put("b", b"3") and not m.put("c", b"4")
    assert (len(m), m.hits, m.misses, m.rejected, m.hit_rate, m.enabled) == (2, 1, 1, 2, 0.5, True)
    off = Memo(0)
    assert not off.put("a", b"1") and len(off) == 0 and not off.enabled and Memo(0).hit_rate == 0.0
    with pytest.raises(ValueError):
        Memo(-1)
    made = []
    m = Memo(2, 9)
    got = m.look_up(["x", "y", "z"], np.array([3, 1, 2]), lambda new: made.append(new) or [w.encode() for w in new])
    assert got == [b"x", b"y", b"z"] and made == [["x", "y", "z"]] and (m.hits, m.misses, m.rejected) == (2, 4, 1)
    k = Kernel(R50K.ranks, "gpt2", 0)
    for _ in range(2):
        ids = k.encode_texts(pa.array(["the cat the cat", "", "a  b", "the\n cat"]))
        assert ids.counts().tolist() == [4, 0, 3, 3] and len(k.memo) == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB\u00e9\u4e2d \n\t1'<|endoftext>\U0001f600\u3000\x85", max_size=40), min_size=1, max_size=6))
def test_batches_equal_single_texts(texts):
    k = Kernel(R50K.ranks, "gpt2", 50)
    for _ in range(2):
        found = k.encode_texts(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(found.ids(), np.cumsum(found.counts())[:-1])] == [np.frombuffer(k.encode(t), "<i4").tolist() for t in texts]


def test_hazards_equal_tiktoken_and_goldens_hold(tmp_path):
    v, texts = R50K, goldens.hazards()
    assert len(texts) > 5000
    o = oracle(GPT2)
    k = Kernel(v.ranks, "gpt2")
    found = k.encode_texts(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(found.ids(), np.cumsum(found.counts())[:-1])] == o.encode_ordinary_batch(texts)
    goldens.write_golden(v, str(tmp_path / "g"), texts[:300])
    assert goldens.differences(v, str(tmp_path / "g")) == []
    lines = (tmp_path / "g").read_text().replace('"id": 5, "bytes": "', '"id": 5, "bytes": "00')
    (tmp_path / "g").write_text(lines)
    assert len(goldens.differences(v, str(tmp_path / "g"))) == 1
    assert goldens.drifted_patterns() == []


def test_windows_by_definition(spark):
    t, rng = Tokenizer.load(spark, "gpt2"), np.random.default_rng(1)
    texts = [" ".join("x" * rng.integers(1, 30) for _ in range(40)) for _ in range(5)] + ["y" * 400 + " z z z"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for most, overlap in ((7, 0), (7, 3), (1, 0), (30, 29)):
        for r in t.windows(d, most, overlap).collect():
            ends, counts = Kernel(R50K.ranks, "gpt2").piece_counts(r.text)
            starts, size = [0, *ends[:-1]], dict(zip([0, *ends[:-1]], counts, strict=True))
            at = 0
            for w in r.windows:
                inside = [s for s in starts if w.start <= s < w.end]
                assert w.start == starts[at] and w.tokens == sum(size[s] for s in inside) and (w.tokens <= most or len(inside) == 1)
                after = at + len(inside)
                assert after == len(starts) or w.tokens + counts[after] > most or len(inside) == 1
                back = after
                while back - 1 > at and sum(counts[back - 1 : after]) <= overlap:
                    back -= 1
                at = back
            assert r.windows[-1].end == len(r.text)


def test_padding_by_batch_encodes_once(spark):
    t = Tokenizer.load(spark, "gpt2")
    rows = [(0, 0, "a b c"), (1, 0, "a"), (2, 1, ""), (3, 1, ""), (4, 2, "a b c d e f g"), (5, 2, None)]
    d = spark.createDataFrame(rows, "doc_id int, batch int, text string")
    p = t.pad(d, 0, 4, batch="batch")
    assert p._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: r for r in p.collect()}
    assert [(got[i].width, got[i].length) for i in range(5)] == [(3, 3), (3, 1), (0, 0), (0, 0), (4, 4)] and got[5].ids is None and got[5].mask is None
    assert list(got[1].mask) == [1, 0, 0] and got[1].ids[1:] == [0, 0]
    assert t.pad(d.limit(0), 0).count() == 0
    with pytest.raises(Exception, match="outside"):
        p.where("doc_id = 1").select(tokens.at(F.col("ids"), 3)).collect()


def test_appending_flat_buffers_fits_and_lengths(spark):
    t = Tokenizer.load(spark, "gpt2")
    d = spark.createDataFrame([(0, "hello world", [1]), (1, None, [2, 3]), (2, "", None)], "doc_id int, text string, old array<int>")
    assert [list(r.old) for r in t.encode_onto(d, "old").orderBy("doc_id").collect()] == [[1, 31373, 995], [2, 3], []]
    e = t.encode_ordinary(d)
    assert [(r.place, r.id) for r in tokens.flat_ids(e).orderBy("place").collect()] == [(0, 31373), (1, 995)]
    for most, want in ((2, [True, None, True]), (1, [False, None, True]), (-1, [False, None, True]), (100, [True, None, True])):
        assert [r.fits for r in t.fits(d, most).orderBy("doc_id").collect()] == want
    ids = spark.createDataFrame([(0,), (50256,), (50280,), (99999,)], "i int")
    got = {r.i: (r.length, r.assigned) for r in tokens.token_bytes(ids, Vocabulary.load("p50k_base"), "i").collect()}
    assert got == {0: (1, True), 50256: (13, True), 50280: (25, True), 99999: (0, False)}
