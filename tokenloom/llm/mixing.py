"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points, in integer arithmetic, are mapped through the sources' cumulative targets: each point is a slot of
``BLOCK_WORDS`` words. A source's slots are ranked; slot r takes the r-th block of the source's shuffled documents, which start
anew after the last one, up to MOST_REPEATS passes. A source whose target is under EXACT_BLOCKS blocks would get none or some by
chance: it takes its target to the word, in whole blocks and a last, shorter one, at slots spread evenly.

Ranks and running sums are taken in two levels (within a slice, plus the sum of the slices before), so a source that holds
a third of everything is spread over ``SLICES`` groups.

Defined cases: null text has size 0; a null source is a source of its own and comes last; documents of size 0 are returned with
taken 0; equal rows, also of one doc_id, are documents of their own, and stand in the order of the table's rows where their shuffling
keys tie; a text of any length is one document, cut into blocks; an empty table gives an empty result; other columns are kept by
``mixed_documents`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch

BLOCK_WORDS = 128
EXACT_BLOCKS = 8
MOST_REPEATS = 3
SLICES = 4096
SEED = "mix"
MODULUS = 2147483647
STEP = 1327217884  #: MODULUS over the golden ratio
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target, lo, hi: shares of all sizes by weight, none above MOST_REPEATS times its source.

    What the resharing settles on is min(cap, level * weight): with the sources by cap over weight, the level is that of the first
    source whose cap isn't below it. One row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    s = s.withColumn("hi", F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total") * MODULUS)
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    return s.withColumn("hi", F.when(last, F.lit(float(MODULUS))).otherwise(F.col("hi"))).select("source", "source_size", "weight", "target", "lo", "hi")


def _before(df: DataFrame, keys: list[str], part: str, amount, name: str) -> DataFrame:
    """For each (keys, part): the sum of amount over the parts before it."""
    w = Window.partitionBy(*keys).orderBy(part)
    sums = df.groupBy(*keys, part).agg(F.sum(amount).alias("_n"))
    return sums.select(*keys, part, (F.sum("_n").over(w) - F.col("_n")).alias(name))


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join where null keys meet, too."""
    b = b.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns))
    on = [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    return a.join(b, on).drop(*(f"_{k}" for k in keys))


def schedule(goals: DataFrame, n_slots: int) -> DataFrame:
    """slot, source, rank: which source each slot takes its words from, and how many slots that source had before."""
    spark = goals.sparkSession
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") % MODULUS * STEP % MODULUS).alias("point"))
    slots = slots.withColumn("cell", F.expr(f"point * {CELLS} div {MODULUS}")).withColumn("slice", F.expr(f"slot * {SLICES} div {max(n_slots, 1)}"))
    cell = lambda x: F.least(F.floor(F.col(x) * CELLS / MODULUS), F.lit(CELLS - 1))
    cells = goals.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    named = slots.join(cells, "cell").where("lo <= point and point < hi").select("slot", "slice", "source")
    before = _before(named, ["source"], "slice", F.lit(1), "n_before")
    ranked = named.withColumn("within", F.row_number().over(Window.partitionBy("source", "slice").orderBy("slot")) - 1)
    return _join(ranked, before, ["source", "slice"]).select("slot", "source", (F.col("n_before") + F.col("within")).alias("rank"))


def exact(goals: DataFrame, n_slots: int, block_words: int) -> DataFrame:
    """slot, source, rank, most: the blocks of each source in goals up to its rounded target, ``most`` words in all."""
    g = goals.select("source", F.round("target").cast("long").alias("most")).where("most > 0")
    g = g.withColumn("n", F.expr(f"(most - 1) div {block_words} + 1")).withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return g.select(F.expr(f"(2 * rank + 1) * {n_slots} div (2 * n)").alias("slot"), "source", "rank", "most")


def shuffled(sizes: DataFrame) -> DataFrame:
    """sizes with start: the words before a document in its source's shuffled order."""
    s = sizes.withColumn("_key", F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    s = s.withColumn("slice", F.substring("_key", 1, 3))
    before = _before(s, ["source"], "slice", "size", "n_before")
    w = Window.partitionBy("source", "slice").orderBy("_key", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("within", F.sum("size").over(w) - F.col("size"))
    return _join(s, before, ["source", "slice"]).withColumn("start", F.col("n_before") + F.col("within")).drop("_key", "slice", "n_before", "within")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents). pieces: slot, source, block, row_id, doc_id, pass, words, first: which words of which document a slot takes.
    documents: row_id, doc_id, source, size, source_size, target, start. row_id numbers the rows of docs."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"), F.monotonically_increasing_id().alias("row_id"))
    sizes = scratch.cut(sizes)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    goals = targets(sizes)
    out = _join(shuffled(sizes), goals.select("source", "source_size", "target"), ["source"])
    n_slots, small = -(-total // block_words), F.col("target") < EXACT_BLOCKS * block_words
    slots = schedule(goals.where(~small), n_slots).withColumn("most", F.lit(None).cast("long"))
    slots = slots.unionByName(exact(goals.where(small), n_slots, block_words))
    passes = out.where("size > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(MOST_REPEATS))))).withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    blocks = passes.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))))
    first = F.greatest(F.col("at"), F.col("block") * block_words)
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - first
    blocks = blocks.select("source", F.col("block").alias("rank"), "row_id", "doc_id", "pass", words.alias("words"), (first - F.col("at")).alias("first"), first.alias("_from"))
    pieces = _join(blocks, slots, ["source", "rank"]).withColumn("words", F.least("words", F.col("most") - F.col("_from"))).where("words > 0")
    return pieces.drop("most", "_from").withColumnRenamed("rank", "block"), out


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, a row for each row of docs."""
    pieces, out = mix(docs, block_words)
    sums = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return out.join(sums, "row_id", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _first_words(text, n) -> F.Column:
    """The text up to its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n), "")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The words that the mix takes, in the order of its slots: a row of docs for each pass over it in which words of it are taken,
    with those words alone (all of them but for the last document that a source's target reaches). n_chars, if there, is counted anew.
    """
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    numbered = Scratch(docs.sparkSession, "mixed").cut(docs.withColumn(own, F.monotonically_increasing_id()))
    pieces, out = mix(numbered.select(F.col(own).alias("doc_id"), "source", "text"), block_words)
    drawn = pieces.groupBy("doc_id", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    drawn = drawn.join(out.select("doc_id", "size"), "doc_id").select(*(F.col(c).alias(f"{own}_{c}") for c in ("doc_id", "slot", "words", "size")))
    taken = numbered.join(drawn, F.col(own) == F.col(f"{own}_doc_id"))
    whole = F.col(f"{own}_words") >= F.col(f"{own}_size")
    taken = taken.withColumn("text", F.when(whole, F.col("text")).otherwise(_first_words(F.col("text"), F.col(f"{own}_words").cast("int"))))
    if "n_chars" in docs.columns:
        taken = taken.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return taken.repartitionByRange(n, f"{own}_slot").sortWithinPartitions(f"{own}_slot", own).select(*docs.columns)
