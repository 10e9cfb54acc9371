"""Operators of the llm subpackage against brute force, exact round trips and held-out labels, on small tables with odd rows."""

import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import bpe_codec, chat, embeddings, fingerprints, language_id, minhash, mixing, quality, secrets, suffix_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "tion", "ing", "erth", "onre"]) + rng.choice(["a", "b", "cde", "", "x1"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    long = words(rng, 3000)
    passage = words(rng, 30)
    texts = [None, "", "   ", "one", long, long, passage + " tail", "head " + passage, "<|endoftext|> x"]
    base = words(rng, 200).split()
    for _ in range(12):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = "edit%d" % rng.randint(0, 99)
        texts.append(" ".join(t))
    texts += [words(rng, rng.randint(1, 60)) for _ in range(20)]
    return [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "a", "b", None]), len(t or ""), "e") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(docs, rows, empty):
    first = {}
    want = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        want[i] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    for hot in (suffix_dedup.HOT_STRINGS, 0, 3):  # each minimizer, and some, split into windows
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.removed_digests(docs, hot).collect()} == want
    assert suffix_dedup.removed_digests(empty).count() == 0


def test_sorted_suffixes():
    s = [b"banana", b"ananas", b"a", b"nab"]
    rng = random.Random(10)
    for strings in (s, ["".join(rng.choices("ab", k=rng.randint(1, 40))).encode() for _ in range(60)], [b"aaaa"] * 5, [bytes([255, 0]), bytes([0])]):
        who, off, common = suffix_dedup.sorted_suffixes(strings)
        got = [strings[w][o:] for w, o in zip(who, off, strict=True)]
        assert got == sorted(x[o:] for x in strings for o in range(len(x)))
        assert common.tolist() == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(got, got[1:], strict=False))]


def test_minhash(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                n = len(sets[i] & sets[j])
                if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 2).collect()} == {i: (len(sets[i]), comp[i]) for i in sets}
    assert minhash.near_duplicates(empty, 2).count() == 0


def test_minhash_of_shared_and_null_ids(spark):
    rng = random.Random(7)
    a, b, c = ([f"{w}{i}" for i, w in enumerate(words(rng, 200).split())] for _ in range(3))
    edit = lambda t, *at: " ".join("edit" if i in at else w for i, w in enumerate(t))
    # Null ids only in the middle of the chain 1 - null - 2; ids 4 and 5 each stand for near-copies of b and of c.
    chain = [edit(a, *range(0, 24, 3)), edit(a), edit(a, *range(100, 124, 3))]
    table = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (4, edit(b, 5)), (4, edit(c, 5)), (5, edit(b, 90)), (5, edit(c, 90)), (6, edit(b)), (7, edit(c))]
    out = minhash.grouped(spark.createDataFrame(table, "doc_id long, text string").repartition(3), 2, []).collect()
    got = {}
    for r in out:
        got.setdefault(r.root, []).append((r.doc_id or 0, r.component_id))
    assert sorted(map(sorted, got.values())) == [[(0, 1), (1, 1), (2, 1)], [(4, 4), (5, 4), (6, 4)], [(4, 4), (5, 4), (7, 4)]]


def test_representatives_of_shared_and_null_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (words(rng, 200) for _ in range(4))
    near = lambda t: t + " end"
    table = [(None, a), (None, b), (None, near(b)), (7, near(c)), (7, d), (5, c), (8, near(d)), (9, near(a)), (None, None), (1, ""), (1, None), (3, c[:300]), (3, c[:300])]
    out = sorted(tuple(r) for r in minhash.representatives(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).fillna("-", ["text"]).fillna(-1).collect())
    got = [r for r in out if r[1] not in (b, near(b))]
    assert got == sorted([(9, near(a)), (7, d), (5, c), (-1, "-"), (1, ""), (1, "-"), (3, c[:300])]) and len(out) == len(got) + 1


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    good, bad = ((words(rng, 80), 1) for _ in range(200)), (("!! " + words(rng, 80).upper().replace(" ", "!! "), 0) for _ in range(200))
    table = [(i, t, q) for i, (t, q) in enumerate([*good, *bad])]
    d = spark.createDataFrame(table, "doc_id long, text string, quality int")
    out = quality.score_quality(d.select("doc_id", "text"), d.select("doc_id", "quality")).join(d, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    labels = d.select("doc_id", "quality")
    assert quality.score_quality(empty, labels).count() == 0 and quality.score_quality(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(3)
    say = {"en": ["the", "of", "and", "with"], "fr": ["le", "est", "que", "dans"]}
    d = spark.createDataFrame([(i, " ".join(rng.choices(say[x], k=30)), x, "s") for i, x in enumerate(["en", "fr"] * 100)], "doc_id long, text string, lang string, source string")
    model = language_id.TextModel.fit(d)
    assert language_id.identify(d, model, host=F.col("source")).where("language <> lang or rejected").count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "12 34", "x")], "doc_id long, text string, source string")
    assert language_id.identify(odd, model, host=F.col("source")).where("rejected").count() == 3
    assert language_id.identify_documents(empty).count() == 0
    pages = spark.createDataFrame([(1, "https://a.example.fr/x", "<html lang=fr><p>zzz</p></html>"), (2, None, None)], "page_id long, url string, html string")
    assert {r.page_id: r.language for r in language_id.identify_pages(pages, model).collect()} == {1: "fr", 2: "und"}


def test_language_rejects_long_texts_of_no_model(spark):
    rng = random.Random(8)
    say = {"en": ["the", "of", "and", "with"], "fr": ["le", "est", "que", "dans"]}
    d = spark.createDataFrame([(i, " ".join(rng.choices(say[x], k=30)), x, "s") for i, x in enumerate(["en", "fr"] * 100)], "doc_id long, text string, lang string, source string")
    gibberish = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1000))
    texts = [gibberish, "Русский язык является одним из самых распространённых языков мира. " * 4, "the of and with " * 100, "le est", "zzq"]
    odd = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    out = {r.doc_id: (r.language, r.rejected) for r in language_id.identify(odd, language_id.TextModel.fit(d), host=F.col("source")).collect()}
    assert out[0] == out[1] == ("und", True) and out[2] == ("en", False) and out[3] == ("fr", False) and not out[4][1]


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|", "<|", "<\\\\|im_end|>", "a<|im_end|", "\n", "<|nl|>"])
def test_chat_round_trip(text):
    for role in ("user", "assistant", "", "odd\nrole", "<|im_start|>"):
        [(r, t, _, _)] = chat.parse(chat.render(role, text))
        assert (r, t) == (role, text)


def test_chat_digests(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (2, 0, None, None), (None, 0, "assistant", "x"), (1, 1, "assistant", "<|im_end|>")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.conversation_digests(d).collect()}
    assert out[1].n_turns == 3 and out[1].loss_sha256 == hashlib.sha256(b"<|im_end|>" * 2).hexdigest() and out[2].loss_chars == 0
    whole = chat.format_conversations(d).where("conv_id = 1").first()
    assert [chat.unescape(whole.formatted[s.start : s.end]) for s in whole.loss_spans] == ["<|im_end|>"] * 2
    assert chat.conversation_digests(d.limit(0)).count() == 0


def test_fingerprints(docs, rows, empty):
    got = {r.doc_id: r for r in fingerprints.compare_with_edited(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[4].fingerprint == got[5].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert fingerprints.compare_with_edited(empty).count() == 0


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    for r in bpe_codec.encode_decode(docs, PATH).collect():
        assert list(r.token_ids) == t.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.extra == "e"
    assert bpe_codec.digests(empty, PATH).count() == 0
    c, rng = bpe_codec.Codec.load(PATH), random.Random(4)
    for _ in range(500):
        s = "".join(rng.choices(["a", "aa", " ", "  ", "\n", "th", "ing", "é", "中", "1", "<|endoftext|>", "'s", "՘"], k=rng.randint(0, 30)))
        assert np.frombuffer(c.encode_batch([s])[0], "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_secrets(spark, empty):
    texts = ['é token = "abc" password: hunter22x', "api_key=0123456789abcdef0123456789abcdef", "AKIA" + "B" * 16, "password: token:abcdef", None, "", "PASSWD='x-y-z-1' " * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in secrets.find_secrets(d).collect():
        want = [(m.start(), m.end()) for m in rule.finditer(r.text or "") if len(m[2]) >= 6]
        assert [(s.start, s.end) for s in r.secret_spans if s.kind == "assign"] == want
    assert secrets.trigram_query(secrets.BASE_RULES[2].pattern) == [] and frozenset({"aki", "kia"}) in secrets.trigram_query("AKIA[A-Z0-9]+")
    clean = secrets.redact(d.withColumn("n_chars", F.lit(0).cast("long"))).where("doc_id = 1").first()
    assert clean.text == "[assign]" and clean.n_chars == 8
    assert secrets.find_secrets(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    v = np.concatenate([base[rng.integers(0, 6, 60)] + 0.12 * rng.normal(size=(60, 16)), rng.normal(size=(20, 16))]).astype("f4")
    v[3] = v[7]
    table = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [1.0, 2.0])]
    d = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    x = v.astype("f8")
    c = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1)) >= 0.95
    comp = np.arange(len(v))
    for _ in range(len(v)):
        comp = np.where(c, comp[None, :], 10**6).min(1)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(d).collect()}
    assert got == {i: (int(c[i].sum()) - 1, int(comp[i])) for i in range(len(v))} | {i: (0, i) for i in range(100, 104)}
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_mixing(docs, rows, empty):
    out = mixing.taken(docs, 8).collect()
    total = sum(r.size for r in out)
    assert total == sum(len((t or "").split()) for _, t, *_ in rows) and len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - total) < 1e-6 and all(abs(sum(x) - t) <= 8 * 4 for (_, t), x in by.items())
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.taken(docs, 8).collect()), key=str)
    assert mixing.taken(empty).count() == 0


def test_mixing_of_small_sources(spark):
    rng = random.Random(9)
    sizes = [("big1", 9000), ("big2", 12000), ("big3", 15000), ("s5", 5), ("s40", 40), (None, 300)] + [(f"t{i}", 20) for i in range(8)]
    table = [(i, words(rng, n // 5), s) for i, (s, n) in enumerate(x for x in sizes for _ in range(5))]
    by = {}
    for r in mixing.taken(spark.createDataFrame(table, "doc_id long, text string, source string")).collect():
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source, r.target), []).append(r.taken)
    small = {s: (t, sum(x)) for (s, t), x in by.items() if t < 8 * mixing.BLOCK_WORDS}
    assert len(small) == 11 and all(n == round(t) > 0 for t, n in small.values())
    assert all(abs(sum(x) - t) <= 4 * mixing.BLOCK_WORDS for (_, t), x in by.items())


def test_redact_takes_whole_pem_keys(spark):
    body = "\n".join("".join(random.Random(i).choices("ABCDEFabcdef0123+/", k=64)) for i in range(20)) + "\nQUJD/w=="
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"a {head}\n{body}\n{end} z", f"a {head}\n{body}\nthen prose", f"a {head} z"]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert [r.text for r in secrets.redact(d).orderBy("doc_id").collect()] == ["a [pem] z", "a [pem]\nthen prose", "a [pem] z"]
