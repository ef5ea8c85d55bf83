"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are runs of letters and digits, lower-cased. A document overlaps an item
where, aligned word by word, a window of 20 words of the item (all of it, if it
is shorter) has at least 80 % equal words; what lies outside the document counts
as unequal. An item of fewer than 15 words must be there word for word.

Each mask names the positions that count and ignores the rest. Items are hashed
under every mask at every position, documents at every second one. The masks
are such that any allowed set of substitutions in any window leaves a hit at both
parities (``tests/llm`` proves it by trying all sets), so nothing that the rule
asks for is missed. Hashes are equality-joined, and every alignment that a hit
names is verified over its whole length.

Null texts and items are empty and overlap nothing. Repeated rows are reported
once per id and text. Null ids are kept. Empty tables give an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import texts
from tracewell.storage import keep

MASKS = ((0, 2, 4, 5, 7), (0, 1, 2, 5, 7), (0, 3, 4, 6, 7), (0, 1, 3, 4, 5))
STRIDE = 2
WINDOW = 20
SUBSTITUTED = 0.2
VERBATIM_BELOW = 15
VERBATIM_SEED = 8
SMALL_ITEMS_BYTES = 8 << 20  # of benchmark text up to which its seeds are copied to every task


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def masks_for(lengths: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """(mask, stride) pairs: the spaced ones for long items, contiguous ones for verbatim items of the lengths there are."""
    found = [(mask, STRIDE) for mask in MASKS] if any(n >= VERBATIM_BELOW for n in lengths) else []
    plain = {min(n, VERBATIM_SEED) for n in lengths if 0 < n < VERBATIM_BELOW}
    return found + [(tuple(range(n)), STRIDE if n == VERBATIM_SEED and VERBATIM_SEED not in lengths else 1) for n in sorted(plain)]


def seeds(hashes: Column, n: Column, masks: list[tuple[tuple[int, ...], int]]) -> Column:
    """Array of (at, seed) under every mask; ``hashes`` are the words' hashes, ``n`` how many."""
    def under(number: int, mask: tuple[int, ...], stride: int) -> Column:
        last = n - 1 - mask[-1]
        found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.lit(number), *(F.get(hashes, i + p) for p in mask)).alias("seed")))
        return F.when(last >= 0, found).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))

    return F.concat(*(under(number, mask, stride) for number, (mask, stride) in enumerate(masks)))


def hashed(rows: DataFrame, *keys: str) -> DataFrame:
    """Word hashes of each row; the array is a column of its own so that it is made once."""
    return rows.select(*keys, F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("words")).select(
        *keys, "words", F.size("words").alias("n"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n) of the benchmark, words as hashes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return keep(hashed(items, "item_id")).filter("n > 0")


def verified(equal: Column, n: Column) -> Column:
    """The most equal words in a window of an alignment; ``equal`` has a 0 or 1 per word of the item."""
    size = F.least(n, F.lit(WINDOW))
    return F.array_max(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.aggregate(
        F.slice(equal, i, size), F.lit(0), lambda a, x: a + x)))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tag, item_id, at, n_equal, n_words): each overlapping item of a document at its best alignment, the first
    among equals. ``at`` is the document's word where the item would begin, ``tag`` the hash of the text."""
    items = items_of(benchmark)
    size, lengths = items.agg(F.sum("n"), F.collect_set(F.least("n", F.lit(VERBATIM_BELOW)))).first()  # at most 15 lengths
    masks = masks_for(lengths)
    if not masks:
        return docs.sparkSession.createDataFrame([], "doc_id long, tag long, item_id long, at int, n_equal int, n_words int")
    every = [(mask, 1) for mask, _ in masks]
    small = size * len(masks) * 32 <= SMALL_ITEMS_BYTES  # four longs a seed, counted
    copied = F.broadcast if small else (lambda frame: frame)
    item_seeds = items.select("item_id", "n", F.explode(seeds(F.col("words"), F.col("n"), every)).alias("s")).select(
        "item_id", "n", F.col("s.at").alias("item_at"), "s.seed")
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    doc_seeds = hashed(rows, "doc_id", "tag").select(
        "doc_id", "tag", F.explode(seeds(F.col("words"), F.col("n"), masks)).alias("s")).select("doc_id", "tag", F.col("s.at").alias("doc_at"), "s.seed")
    lines = doc_seeds.join(copied(item_seeds), "seed").select("doc_id", "tag", "item_id", "n", (F.col("doc_at") - F.col("item_at")).alias("at")).distinct()
    aligned = keep(lines.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("item_id", "n", "at")).alias("lines")))  # of one document
    named = aligned.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "lines")
    there = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    own = hashed(there, "doc_id", "tag", "lines").select("doc_id", "tag", F.col("words").alias("doc_words"), F.explode("lines").alias("l"))
    pieces = own.select("doc_id", "tag", "l.item_id", "l.at", F.slice(
        "doc_words", F.greatest(F.col("l.at"), F.lit(0)) + 1, F.greatest(F.col("l.n") + F.least(F.col("l.at"), F.lit(0)), F.lit(0))).alias("part"))
    checked = pieces.join(copied(items.select("item_id", "words", F.col("n").alias("n_words"))), "item_id")
    lead = F.greatest(-F.col("at"), F.lit(0))
    part = F.concat(F.array_repeat(F.lit(None).cast("long"), lead), F.col("part"))
    equal = F.zip_with("words", F.slice(part, F.lit(1), F.col("n_words")), lambda a, b: F.when(a == b, 1).otherwise(0))
    checked = checked.select("doc_id", "tag", "item_id", "at", "n_words", equal.alias("equal")).select(
        "doc_id", "tag", "item_id", "at", "n_words", verified(F.col("equal"), F.col("n_words")).alias("n_equal"))
    wanted = F.when(F.col("n_words") < VERBATIM_BELOW, F.col("n_words")).otherwise(
        F.ceil(F.least("n_words", F.lit(WINDOW)) * (1 - SUBSTITUTED)))
    best = checked.filter(F.col("n_equal") >= wanted).groupBy("doc_id", "tag", "item_id", "n_words").agg(
        F.max(F.struct("n_equal", (-F.col("at")).alias("_at"))).alias("b"))
    return best.select("doc_id", "tag", "item_id", (-F.col("b._at")).alias("at"), "b.n_equal", "n_words")


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with their own columns."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("_llm_id"), F.col("tag").alias("_llm_tag")).distinct()
    tag = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_llm_id"]) & (tag == found["_llm_tag"]), "left_anti")
