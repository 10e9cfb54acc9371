"""Document fingerprints after I-Match: terms within a band of inverse document frequency, sorted and distinct, are hashed for
several randomised subsets of the lexicon.

The first subset is the whole lexicon, with a 64-bit hash. Each of FAMILIES halves it LEVELS times by bits of its own of the term's
hash, so documents of any length find subsets in which they have few terms; an edit then leaves some of the hashes as they are. The
likeness of two fingerprints is the share of equal hashes among the subsets in which either has terms.

The lexicon holds the terms that are in LEAST_SHARE to MOST_SHARE of the documents, and in two at least. The shares of all terms
add up to the mean number of distinct terms in a document, so it holds that mean over LEAST_SHARE terms at most, however many
documents there are. It is counted: up to MOST_BROADCAST terms are broadcast, more are joined by shuffling.

Terms are the stretches of letters and digits of the lower-cased text, known by their 64-bit hashes. Defined cases: null text
counts as empty; every row has a row in the result, rows with one doc_id and different texts by the text's hash, equal rows one
after the other (the next document of all but the last of them is an equal row); a null doc_id comes last in descending order; a
document without a term in the band is fingerprinted by all its terms; empty texts are alike; texts of any length are taken whole;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch

LEAST_SHARE, MOST_SHARE, LEAST_DOCUMENTS = 0.002, 0.2, 2
FAMILIES, LEVELS = 12, 9
MOST_BROADCAST = 4_000_000  #: terms; some 100 MB as a hashed relation
BREAK = r"[^\p{L}\p{N}]+"
#: A document's key, without nulls, so that what a join has dealt by it need not be dealt again for grouping by it.
KEY = ["key_id", "key_null", "text_hash"]


def term_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), BREAK), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, n_documents: int, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """The terms in the band."""
    counts = texts.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counts.where((F.col("n") >= max(LEAST_DOCUMENTS, least_share * n_documents)) & (F.col("n") <= max(LEAST_DOCUMENTS, most_share * n_documents)))
    return band.select("term")


def hash_subsets(d: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replaces each array column of sorted distinct terms by its fingerprint: ``whole``, the 64-bit hash of all terms, and
    ``parts``, the 15-bit hashes of the subsets; 0: no term in that subset.

    ``columns`` names for each the hash of all terms of the text, which stands for one without terms in the lexicon. A family's next
    subset is filtered from the one before, so all subsets of a family cost little more than two passes over the terms.
    """
    plain = [c for c in d.columns if c not in columns and c not in columns.values()]
    digest = lambda terms: f"IF(size({terms}) > 0, CAST(1 + pmod(xxhash64({terms}), 32767) AS short), 0S)"
    pairs = [(c, f) for c in columns for f in range(FAMILIES)]
    names = [f"_in_{c}_{f}" for c, f in pairs]
    now = d.selectExpr(*plain, *(f"IF(size({c}) > 0, xxhash64({c}), {everything}) AS _h_{c}" for c, everything in columns.items()), *(f"{c} AS _in_{c}_{f}" for c, f in pairs))
    done = [f"_h_{c}" for c in columns]
    for level in range(LEVELS):
        now = now.selectExpr(*plain, *done, *(f"filter(_in_{c}_{f}, x -> xxhash64(x, {f}) & {1 << level} = 0) AS _in_{c}_{f}" for c, f in pairs))
        fresh = {f"_h_{c}_{f * LEVELS + level}": digest(f"_in_{c}_{f}") for c, f in pairs}
        now = now.selectExpr(*plain, *done, *(f"{e} AS {name}" for name, e in fresh.items()), *names)
        done += fresh
    return now.selectExpr(*plain, *(f"struct(_h_{c} AS whole, array({', '.join(f'_h_{c}_{j}' for j in range(FAMILIES * LEVELS))}) AS parts) AS {c}" for c in columns))


def likeness(a: Column, b: Column) -> Column:
    """Every text has a hash of all its terms, so at least one subset counts."""
    both = F.zip_with(a["parts"], b["parts"], lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 3).otherwise(1))
    active = F.size(F.filter(both, lambda x: x > 0)) + 1
    return (F.size(F.filter(both, lambda x: x == 3)) + (a["whole"] == b["whole"]).cast("int")) / active


def render(fingerprint: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(fingerprint["whole"])), 16, "0"), F.array_join(F.transform(fingerprint["parts"], lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ""))


def successors(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """keys (KEY, copies, ...) with next_id, next_null, next_hash, again and times: the key that follows in descending order, the first
    after the last. A key of several rows has a second row (again) for all of them but the last, which are followed by itself.

    Rows are ordered by range partitions; only one row of each partition meets the others.
    """
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("key_null").asc(), F.col("key_id").desc(), F.col("text_hash").desc()]
    dealt = scratch.cut(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    key = F.struct(*KEY)
    w = Window.partitionBy("part").orderBy(*order)
    inner = dealt.withColumn("next", F.lead(key).over(w))
    firsts = dealt.withColumn("at", F.row_number().over(w)).where("at = 1").select("part", key.alias("first"))
    whole = Window.orderBy("part")
    firsts = firsts.withColumn("then", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    following = F.broadcast(firsts.select("part", "then"))  # a row for each partition
    out = inner.join(following, "part").withColumn("next", F.coalesce("next", "then"))
    times = F.array(F.struct(F.lit(False).alias("again"), F.lit(1).cast("long").alias("times"), F.col("next")), F.struct(F.lit(True).alias("again"), (F.col("copies") - 1).alias("times"), key.alias("next")))
    out = out.withColumn("x", F.explode(F.when(F.col("copies") > 1, times).otherwise(F.slice(times, 1, 1))))
    names = dict(zip(("next_id", "next_null", "next_hash"), KEY, strict=True))
    return out.withColumns({n: F.col(f"x.next.{k}") for n, k in names.items()} | {"again": F.col("x.again"), "times": F.col("x.times")}).drop("part", "next", "then", "x", "copies")


def fingerprint_texts(texts: DataFrame, columns: tuple[str, str], words: DataFrame, carry: list[str]) -> DataFrame:
    """KEY, again, carry and, for both text columns c, fp_c: its fingerprint. texts are rows of distinct (KEY, again).

    A term meets the lexicon once for both texts. What a row carries goes with a row of its own. texts come from a join on KEY, so
    with a broadcast lexicon nothing is shuffled here.
    """
    one, two = columns
    d = texts.withColumns({f"_t_{c}": term_hashes(F.col(c)) for c in columns})
    info = F.struct(*carry, *(F.xxhash64(F.sort_array(f"_t_{c}")).alias(f"_all_{c}") for c in columns))
    d = d.select(*KEY, "again", info.alias("_info"), F.col(f"_t_{one}").alias("_one"), F.col(f"_t_{two}").alias("_two"))
    nothing = F.lit(None).cast(d.schema["_info"].dataType)
    row = lambda which, term, said: F.struct(F.lit(which).alias("which"), term.alias("term"), said.alias("info"))
    rows_of = lambda which, terms: F.transform(terms, lambda t: row(which, t, nothing))
    dealt = ((3, F.array_intersect("_one", "_two")), (1, F.array_except("_one", "_two")), (2, F.array_except("_two", "_one")))
    rows = F.concat(F.array(row(0, F.col("text_hash"), F.col("_info"))), *(rows_of(which, terms) for which, terms in dealt))
    d = d.select(*KEY, "again", F.explode(rows).alias("x")).select(*KEY, "again", "x.*")
    known = words.withColumn("_known", F.lit(True))
    d = d.join(F.broadcast(known) if words.count() <= MOST_BROADCAST else known, "term", "left").where("_known or which = 0")
    in_text = lambda bit: F.collect_list(F.when(F.col("which").bitwiseAND(bit) != 0, F.col("term")))
    g = d.groupBy(*KEY, "again").agg(F.first("info", ignorenulls=True).alias("info"), *(F.sort_array(in_text(1 << i)).alias(f"fp_{c}") for i, c in enumerate(columns)))
    return hash_subsets(g.select(*KEY, "again", "info.*", *(f"fp_{c}" for c in columns)), {f"fp_{c}": f"_all_{c}" for c in columns})


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row, where the edited
    text has its last third replaced by the beginning of the next document in descending doc_id."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("key_id"), F.col("doc_id").isNull().alias("key_null"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("key_id", "key_null", F.xxhash64("text").alias("text_hash"), "text")
    keys = texts.groupBy(*KEY).agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    links = scratch.cut(successors(keys, scratch))
    n = links.agg(F.sum("times")).first()[0] or 0
    words = scratch.cut(lexicon(texts, n))
    texts = texts.dropDuplicates(KEY) if links.where("again").limit(1).count() else texts
    cut_at = F.floor(F.col("n_chars") / 3).cast("int")
    after = ["next_id", "next_null", "next_hash"]
    meets = lambda a, b: [F.col(x) == F.col(y) for x, y in zip(a, b, strict=True)]
    heads = texts.alias("t").join(links.alias("l"), meets([f"t.{k}" for k in KEY], after))
    heads = heads.select(*(F.col(f"l.{k}").alias(f"h_{k}") for k in KEY), "again", "times", "n_chars", *after, F.substring(F.col("t.text"), F.lit(1), cut_at).alias("head"))
    both = texts.join(heads, meets(KEY, [f"h_{k}" for k in KEY]))
    both = both.select(*KEY, "again", "times", "n_chars", *after, "text", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut_at), F.col("head")).alias("edited"))
    both = both.withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    found = scratch.cut(fingerprint_texts(both, ("text", "edited"), words, ["times", "n_chars", *after, "edited_sha256"]))
    nexts = found.where("not again").select(*(F.col(k).alias(f"a_{k}") for k in KEY), F.col("fp_text").alias("fp_next"))
    out = found.join(nexts, meets(after, [f"a_{k}" for k in KEY]))
    doc_id = F.when(~F.col("key_null"), F.col("key_id"))
    out = out.select(
        doc_id.alias("doc_id"), "times", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), render(F.col("fp_text")).alias("fingerprint"), render(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_text"), F.col("fp_next")).alias("near_next"),
    )
    return out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_", "times")
