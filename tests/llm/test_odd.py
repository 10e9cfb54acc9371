"""Odd inputs, split paths and brute-force versions of the llm operators and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import words

from tokenloom.llm import bpe_codec, chat, embeddings, fingerprints, language_id, minhash, mixing, quality, secrets, suffix_dedup
from tokenloom.llm.queries_basic import BPE_FILE
from tokenloom.llm.scratch import collected, shared_dir


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


# ---- op1


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away from all of it " * 2
    rows = [(1, "a " + passage + "b"), (1, "c " + passage), (2, passage[:60] + "X" * 60 + passage[60:130]), (None, passage), (3, None), (None, "Y" * 30000 + passage)]
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame(spark, rows, "doc_id long, text string")).collect())
    n = len(passage)
    # Rows of one id don't repeat each other; id 2 has two stretches from id 1; the null ids come last.
    assert got == [(1, n + 2, 0, 0), (1, n + 3, 0, 0), (2, 190, 130, 2), (3, 0, 0, 0), (99, n, n, 1), (99, 30000 + n, n, 1)]


# ---- op2


def components(texts, n_words):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = set(zip(*(w[k:] for k in range(n_words)), strict=False)) if len(w) >= n_words else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                n = len(sets[i] & sets[j])
                if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return comp


@pytest.mark.parametrize("unit", [2, 7, 512])
def test_minhash_in_blocks(spark, monkeypatch, unit):
    """Chains in which many texts share bands without being alike to the band's centre."""
    monkeypatch.setattr(minhash, "UNIT_SETS", unit)
    rng, texts = random.Random(11), {}
    for c in range(3):
        now = [f"w{c}x{i}" for i in range(60)]
        for k in range(14):
            texts[100 * c + k] = " ".join(now)
            now = list(now)
            for _ in range(4):
                now[rng.randrange(60)] = f"e{rng.randint(0, 10**6)}"
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, list(texts.items()), "doc_id long, text string"), 2).collect()}
    assert got == components(texts, 2)


# ---- op3


def test_quality_of_odd_rows(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, 30), "x", 1.0) for i in range(60)] + [(60, None, "x", 1.0), (60, "", "x", 1.0), (None, "a b", "x", 1.0), (61, "word " * 50000, "x", 1.0), (62, "same", "x", 1.0), (63, "same", "x", 1.0)]
    docs = frame(spark, rows, "doc_id long, text string, features string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels).collect()
    by = {r.doc_id: r.score for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out) and by[62] == by[63]


# ---- op4


def fuse(model, rows):
    """language and posterior of (text, host, domain, suffix, declared) rows, by the formula in plain numpy."""
    n = len(model.languages)
    logs, ok = [], []
    for text, *_ in rows:
        mean, count = model.score([(text or "").encode()])
        logs.append(mean[0] * language_id.TEXT_WEIGHT * min(count[0], language_id.MOST_TRIGRAMS))
        ok.append(any(map(str.isalpha, text or "")) and (mean[0].max() > -np.log(language_id.BUCKETS) or count[0] < language_id.FLAT_TRIGRAMS))
    p = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs]
    sums = lambda ks: sum((p[k] for k in ks if ok[k]), np.zeros(n))
    out = []
    for k, (_, host, domain, suffix, declared) in enumerate(rows):
        every = sums(range(len(rows)))
        base = (every + 1) / (every.sum() + n)
        dom = sums(j for j, r in enumerate(rows) if (r[2] or "") == (domain or ""))
        # The domain's sums go by host and domain, as hosts do.
        mid = (dom + language_id.DOMAIN_STRENGTH * base) / (dom.sum() + language_id.DOMAIN_STRENGTH)
        own = sums(j for j, r in enumerate(rows) if (r[1] or "", r[2] or "") == (host or "", domain or ""))
        low = (own + language_id.HOST_STRENGTH * mid) / (own.sum() + language_id.HOST_STRENGTH)
        total = logs[k] + np.log(low)
        for hint, right in ((language_id.SUFFIXES.get(suffix), language_id.SUFFIX_RIGHT), ((declared or "")[:2].lower() or None, language_id.DECLARED_RIGHT)):
            if hint in model.languages:
                total = total + np.log([right if x == hint else (1 - right) / (n - 1) for x in model.languages])
        q = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        gone = not ok[k] or q.max() < language_id.LEAST_POSTERIOR
        out.append(("und" if gone else model.languages[int(q.argmax())], round(float(q.max()), 9), gone))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    say = {"en": ["the", "of", "and", "with"], "fr": ["le", "est", "que", "dans"], "de": ["der", "und", "nicht", "ist"]}
    d = spark.createDataFrame([(i, " ".join(rng.choices(say[x], k=30)), x) for i, x in enumerate(["en", "fr", "de"] * 60)], "doc_id long, text string, lang string")
    return language_id.TextModel.fit(d)


CLASHES = "p string, text_logs string, explained string, _evidence string, _evidence_host string, host_logs string, language string, _host string"


def test_language_against_its_formula(spark, model):
    rng = random.Random(13)
    texts = ["the of and", "le est que", "der und ist", "zz", "", None, "12", "the le der", "und " * 5000]
    rows = [(rng.choice(texts), h := rng.choice(["a.x.fr", "b.x.fr", "c.de", None]), h and ".".join(h.split(".")[-2:]), h and h.split(".")[-1], rng.choice(["fr", "EN-us", None, "xx"])) for _ in range(40)]
    table = [(i, *r, *["c"] * 8) for i, r in enumerate(rows)]
    d = frame(spark, table, f"i int, body string, h string, d string, s string, l string, {CLASHES}")
    out = language_id.identify(d, model, "body", host=F.col("h"), domain=F.col("d"), suffix=F.col("s"), declared=F.col("l")).orderBy("i").collect()
    assert [(r.language, round(r.posterior, 9), r.rejected) for r in out] == fuse(model, rows)
    assert all(r.p == r._evidence == r.host_logs == r._host == "c" for r in out)


def test_language_of_pages_against_its_formula(spark, model):
    html = lambda lang, text: f"<html lang='{lang}'><style>le le</style><p>{text}</p></html>"
    pages = [(1, "https://www.a.fr/x", html("fr", "le est que")), (2, "https://b.a.fr/y", html("en", "zz")), (3, "http://c.example.de:80/z", "<p>der und"), (4, None, None), (5, "no address", html("de", "the of"))]
    rows = []
    for _, url, body in pages:
        host = (re.findall(r"^[A-Za-z]+://([^/:?#]+)", url or "") or [None if url is None else ""])[0]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", body or ""))
        rows.append((plain, host, (re.findall(r"([^.]+\.[^.]+)$", host or "") or [""])[0], (re.findall(r"\.([a-z]{2})$", host or "") or [None])[0], (re.findall(r"<html[^>]*lang='(..)", body or "") or [None])[0]))
    out = language_id.identify_pages(frame(spark, [(*p, "mine") for p in pages], "page_id long, url string, html string, _plain string"), model).orderBy("page_id").collect()
    assert [(r.language, round(r.posterior, 9), r.rejected) for r in out] == fuse(model, rows) and all(r._plain == "mine" for r in out)


# ---- op5


def test_chat_of_a_long_conversation(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"<|im_end|> turn {i}\n") for i in range(20000)] + [(2, 0, "assistant", "x" * 3_000_000)]
    got = {r.conv_id: r for r in chat.conversation_digests(frame(spark, turns, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("mine"))).collect()}
    spoken = "".join(t for _, i, r, t in turns[:20000] if r == "assistant")
    assert got[1].n_turns == 20000 and got[1].loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest() and got[2].loss_chars == 3_000_000


# ---- op6


def test_fingerprints_against_brute_force(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    text_hash = lambda t: signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
    fold = lambda x, seed: xxhash.xxh64((x % 2**64).to_bytes(8, "little"), seed=seed % 2**64).intdigest()

    def all_of(terms):
        h = 42
        for t in sorted(terms):
            h = fold(t, h)
        return h

    rng = random.Random(14)
    rows = [(i, words(rng, rng.randint(0, 60))) for i in range(40)] + [(5, "a second text of five"), (7, None), (7, None), (None, "x"), (None, "x"), (None, "y")]
    texts = [(i, t or "") for i, t in rows]
    ranked = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), -text_hash(r[1])))
    terms_of = lambda t: {text_hash(w) for w in re.split(r"[\W_]+", t.lower()) if w}
    counts = {}
    for _, t in set(ranked):
        for x in terms_of(t):
            counts[x] = counts.get(x, 0) + ranked.count((_, t))
    band = {x for x, n in counts.items() if max(2, 0.002 * len(rows)) <= n <= max(2, 0.2 * len(rows))}

    def fingerprint(t):
        own = terms_of(t) & band
        parts = []
        for f in range(fingerprints.FAMILIES):
            now = sorted(own)
            for level in range(fingerprints.LEVELS):
                now = [x for x in now if not xxhash.xxh64(f.to_bytes(4, "little"), seed=fold(x, 42)).intdigest() >> level & 1]
                parts.append(1 + signed(all_of(now)) % 32767 if now else 0)
        return all_of(own or terms_of(t)), parts

    def like(a, b):
        active = 1 + sum(x or y for x, y in zip(*[[bool(x) for x in p[1]] for p in (a, b)], strict=True))
        return ((a[0] == b[0]) + sum(x == y and x > 0 for x, y in zip(a[1], b[1], strict=True))) / active

    want = []
    for k, (i, t) in enumerate(ranked):
        after = ranked[(k + 1) % len(ranked)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, e, n = fingerprint(t), fingerprint(edited), fingerprint(after)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a[0]:016x}" + "".join(f"{x:04x}" for x in a[1]), round(like(a, e), 9), round(like(a, n), 9)))
    got = fingerprints.compare_with_edited(frame(spark, [(*r, "c") for r in rows], "doc_id long, text string, key_id string")).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


# ---- op7


def test_bpe_of_long_words_and_repeated_rows(spark):
    from tokenizers import Tokenizer

    texts = ["ab" * 20000, "é" * 5000 + " x", "same words here", "same words here", " " * 3000 + "x", "<|endoftext|>" * 50]
    t = Tokenizer.from_file(BPE_FILE)
    d = frame(spark, [(i, x, "mine") for i, x in enumerate(texts)], "doc_id long, text string, memo string")
    for r in bpe_codec.encode_decode(d, BPE_FILE).collect():
        assert list(r.token_ids) == t.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text and r.memo == "mine"
    assert bpe_codec.encoded(d, BPE_FILE).where("round_trips and n_tokens = size(token_ids)").count() == len(texts)


# ---- op8


def test_secrets_of_many_matches_and_clashing_names(spark):
    text = "".join(f"é password = word{i:05d} " for i in range(1000))
    docs = frame(spark, [(1, text, "mine", 0), (1, text, "mine", 0), (2, "x" * 200000 + " AKIA" + "Q" * 16, "mine", 0), (3, None, "mine", 0)], "doc_id long, text string, secret_spans string, n_chars int")
    out = secrets.find_secrets(docs.withColumnRenamed("secret_spans", "_scan")).orderBy("doc_id").collect()
    want = [(m.start(), m.end()) for m in re.finditer(r"password = word\d+", text)]
    assert [(s.start, s.end) for s in out[0].secret_spans] == [(s.start, s.end) for s in out[1].secret_spans] == want and out[0]._scan == "mine"
    assert [(s.kind, s.start, s.end) for s in out[2].secret_spans] == [("access", 200001, 200021)]
    clean = secrets.redact(docs).orderBy("doc_id").collect()
    assert clean[0].text == "é [assign] " * 1000 and clean[0].secret_spans == "mine" and clean[3].text is None


# ---- op9


@pytest.mark.parametrize("cell, block", [(5, 3), (20, 1000)])
def test_embeddings_in_cells_and_blocks(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(15)
    base = rng.normal(size=(8, 12))
    v = base[rng.integers(0, 8, 70)] + 0.15 * rng.normal(size=(70, 12))
    v[5] = v[6]
    table = [(i if i % 9 else None, x.tolist()) for i, x in enumerate(v)] + [(1, v[1].tolist()), (2, None)]
    x = np.array([e for _, e in table if e])
    c = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1)) >= 0.95
    big = np.array([10**6 if i is None else i for i, e in table if e])
    comp = big.copy()
    for _ in range(len(x)):
        comp = np.where(c, comp[None, :], 10**6).min(1)
    want = sorted([(str(None if i == 10**6 else i), int(n) - 1, str(None if k == 10**6 else k)) for i, n, k in zip(big.tolist(), c.sum(1), comp.tolist(), strict=True)] + [("2", 0, "2")])
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicates(frame(spark, table, "vec_id long, embedding array<double>").withColumn("id", F.lit("mine"))).collect())
    assert got == want


# ---- op10


def test_mixed_documents_hold_the_words_that_are_taken(spark):
    rng = random.Random(16)
    rows = [(i if i % 5 else 5, "\n".join(words(rng, 8) for _ in range(rng.randint(0, 12))) or None, rng.choice(["a", "b", "b", None]), "m", "n") for i in range(80)]
    docs = frame(spark, rows, "doc_id long, text string, source string, _mix string, _mix_slot string").cache()
    n_words = lambda t: len((t or "").split())
    taken, mixed = {}, {}
    for r in mixing.taken(docs, 8).collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
    originals = {r[1] for r in rows}
    out = mixing.mixed_documents(docs, 8).collect()
    for r in out:
        mixed[r.doc_id, r.source] = mixed.get((r.doc_id, r.source), 0) + n_words(r.text)
        assert r._mix == "m" and r._mix_slot == "n"
    by = lambda d: {s: sum(n for (_, x), n in d.items() if x == s) for s in ("a", "b", None)}
    assert by(mixed) == by(taken)
    assert sum(r.text not in originals for r in out) <= 3 and all(any(o and o.startswith(r.text) for o in originals) for r in out)


# ---- the pipeline


def test_pipeline_accounts_for_every_row(spark, tmp_path, model):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(17)
    say = {"en": ["the", "of", "and", "with", "house", "green"], "fr": ["le", "est", "que", "dans", "maison", "vert"]}
    talk = lambda lang, n: " ".join(rng.choices(say[lang], k=n)) + f" {lang}{rng.randint(0, 10**9)}"
    rows = [(i, talk(x := rng.choice(["en", "fr"]), 60), x, rng.choice(["s1", "s2", None])) for i in range(60)]
    long = talk("en", 400)
    rows += [(100, long, "en", "s1"), (101, long + " more", "en", "s2"), (None, long, "en", "s1"), (102, None, "en", "s1"), (103, "", "fr", "s1"), (104, "1234 5678", "en", "s1")]
    rows += [(7, talk("fr", 50) + " password: hunter22x end", "fr", "s2"), (None, talk("fr", 40), "fr", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    steps = [docs]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or now.columns == docs.columns
        steps.append(now)
    kept, alone, clean, mixed, coded = ([r.asDict() for r in s.collect()] for s in steps[1:])
    spoken = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    assert sorted(r["text"] for r in kept) == sorted(r[1] for r in spoken) and all(r["lang"] in ("en", "fr") for r in kept)
    groups = components({k: r["text"] for k, r in enumerate(kept)}, 5)
    assert len(alone) == len(set(groups.values())) and {r["text"] for r in alone} <= {r["text"] for r in kept} and 100 in [r["doc_id"] for r in alone] and 101 not in [r["doc_id"] for r in alone]
    assert sorted(r["text"] for r in clean) == sorted(r["text"].replace("password: hunter22x", "[assign]") for r in alone)
    whole = {r["text"] for r in clean}
    assert all(any(w.startswith(r["text"]) for w in whole) and r["n_chars"] == len(r["text"]) for r in mixed)
    n_words = lambda rs, s: sum(len(r["text"].split()) for r in rs if r["source"] == s)
    targets = {r.source: r.target for r in mixing.taken(steps[3]).collect()}
    assert all(abs(n_words(mixed, s) - t) <= 4 * mixing.BLOCK_WORDS for s, t in targets.items())
    t = Tokenizer.from_file(BPE_FILE)
    assert sorted(str(list(r["token_ids"])) for r in coded) == sorted(str(t.encode(r["text"], add_special_tokens=False).ids) for r in mixed) and all(r["round_trips"] for r in coded)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(coded)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# ---- scratch


def test_scratch_is_cleared_and_keeps_the_session(spark, tmp_path):
    import os

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with collected() as made:
        minhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"), 2).count()
    assert made and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    roots = [s.root.removeprefix("file://") for s in made]
    assert any(map(os.path.isdir, roots))
    for s in made:
        s.clear()
    assert not any(map(os.path.isdir, roots)) and shared_dir(spark)
