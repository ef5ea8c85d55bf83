"""Phrase collocations from truncated suffix subtrees, grouped by a memory budget.

Every word of a text starts a suffix: itself and what follows in its piece, up to
``DEPTH`` words. Suffixes with the same first words make a subtree, and subtrees are
independent, so each can be built alone as long as it fits in memory. Vertical
partitioning decides on the prefixes: the suffixes of one word go together unless
they may exceed the budget; then they are parted by two words, and so on. Light
prefixes are dealt by hash into groups of about half a budget.

1. One pass finds the heavy prefixes. A task reports prefixes whose share of the
   suffixes it has seen is at least half of a budget's share of all, so a prefix that
   exceeds the limit anywhere near the whole corpus is sure to be reported, and what is
   reported is bounded by the number of groups, not by the text.
2. A second pass sorts the suffixes of a task, counts equal ones once, and sends each
   group one packed block of them.
3. A group merges its blocks into one sorted array of different suffixes with counts,
   which is its subtree laid flat: nodes are runs with the same first words, and the
   count of a node is the sum of its leaves. Nodes of ``least`` or more go out.

From there on all is joins on phrases: the counts of both parts of each cut, the
longer phrases that hold a candidate, and the best of each language. Products use
38-digit decimals.

Words are parted at spaces and tabs, pieces at other white space and ``.,;:!?``; A-Z are
lower-cased. A null text has no words, a null language is ``und``. Rows count each,
repeated ones too; very long texts are cut nowhere, as a suffix needs no more than its
piece. An empty table, or one without a frequent phrase, gives an empty result. Other
columns are left out. Ties go by the phrase in the order of its bytes.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.skew import lookup_join
from tracewell.storage import cut, keep

DEPTH = 4  # words of the longest phrase
LEAST = 30
COVERED = (80, 100)  # a longer phrase with this share of a candidate's count drops it
SCALE = 2_000_000
TOP = 2000
GROUP_BYTES = 8 << 20  # of text whose suffixes a task holds at a time
HEAVY = 8  # a prefix is extended where it may hold more than this part of a group
CHUNK_BYTES = 3 << 20  # of text that a task sorts at a time
SALTS = 64  # parts of a language that are ranked by themselves
MIX, SPIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
BLOCKS = "grp long, langs array<string>, packed binary"


@lru_cache(maxsize=1)
def byte_kinds() -> np.ndarray:
    """What each byte becomes: lower case, a space between words, a line feed between pieces."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[ord("\t")] = ord(" ")
    table[list(b".,;:!?\n\x0b\x0c\r")] = ord("\n")
    return table


class Suffixes:
    """Different suffixes of some texts with their counts: columns of codes, 0 where a piece has ended."""

    def __init__(self, langs: list[str], words: pa.Array, lang: np.ndarray, codes: list[np.ndarray], counts: np.ndarray):
        self.langs, self.words, self.lang, self.codes, self.counts = langs, words, lang, codes, counts

    def rows(self) -> int:
        return len(self.counts)

    def merged(self) -> Suffixes:
        """Sorted, equal ones once."""
        if not self.rows():
            return self
        packed, width = self.lang.astype(np.uint64), int(len(self.words) + 1).bit_length()
        for column in self.codes:  # as many columns in a 64-bit key as fit, those before by their rank
            if int(packed.max()).bit_length() + width > 63:
                packed = np.unique(packed, return_inverse=True)[1].astype(np.uint64)
            packed = (packed << np.uint64(width)) | column.astype(np.uint64)
        order = np.argsort(packed)
        packed = packed[order]
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        lang, *codes = (k[order[first]] for k in (self.lang, *self.codes))
        return Suffixes(self.langs, self.words, lang, codes, np.add.reduceat(self.counts[order], first))

    def prefixes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First rows and counts of the nodes of a depth, of merged suffixes; nodes that go beyond the end of a piece are none."""
        fresh = np.ones(self.rows(), bool)
        if self.rows():
            fresh[1:] = self.lang[1:] != self.lang[:-1]
            for column in self.codes[:depth]:
                fresh[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(fresh)
        counts = np.add.reduceat(self.counts, first) if len(first) else np.empty(0, np.int64)
        whole = self.codes[depth - 1][first] > 0
        return first[whole], counts[whole]

    def hashes(self, depth: int) -> list[np.ndarray]:
        """Hash of each suffix's first words, for 1 word up to ``depth``."""
        own = np.concatenate([[np.uint64(0)], np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_numpy(zero_copy_only=False)), np.uint64, len(self.words))])
        state = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.langs], np.uint64)[self.lang]
        out = []
        for column in self.codes[:depth]:
            state = (state ^ own[column]) * MIX
            state = (state ^ (state >> np.uint64(29))) * SPIN
            state = state ^ (state >> np.uint64(32))
            out.append(state)
        return out


def suffixes_of(data: np.ndarray, ends: np.ndarray, langs: list[str], lang_of: np.ndarray) -> Suffixes:
    """All suffixes of texts that lie one after the other in ``data``, text i up to ``ends[i]``, merged."""
    data = byte_kinds()[data]
    solid = (data != 32) & (data != 10)
    edge = np.zeros(len(data) + 1, bool)  # where a text begins
    edge[ends] = True
    edge[0] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return Suffixes(langs, pa.array([], pa.binary()), np.empty(0, np.int32), [np.empty(0, np.int32)] * DEPTH, np.empty(0, np.int64))
    breaks = np.searchsorted(np.flatnonzero((data == 10) | edge[:-1]), starts, "right")  # equal for words of one piece
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(end) + 1 - starts)])
    letters = data[solid]
    del begin, end, edge, solid
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = plain.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int32) + 1
    lang = lang_of[np.searchsorted(ends, starts, "right")].astype(np.int32)
    codes, n = [code], len(code)
    for k in range(1, DEPTH):
        after = np.zeros(n, np.int32)
        if k < n:
            after[:-k] = np.where(breaks[k:] == breaks[:-k], code[k:], 0)
        codes.append(after)
    return Suffixes(langs, coded.dictionary.cast(pa.binary()), lang, codes, np.ones(n, np.int64)).merged()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    """Suffixes of some ``CHUNK_BYTES`` of text at a time."""
    held, size = [], 0

    def drawn() -> Suffixes:
        table = pa.Table.from_batches(held)
        text = table.column("text").cast(pa.large_binary()).combine_chunks()
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        lang = table.column("lang").combine_chunks().dictionary_encode()
        return suffixes_of(data, offsets[1:] - offsets[0], lang.dictionary.to_pylist(), lang.indices.to_numpy())

    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
        start = 0
        while start < len(lengths):
            room = np.cumsum(lengths[start:])
            end = start + max(1, int(np.searchsorted(room, CHUNK_BYTES - size, "right")))
            held.append(batch.slice(start, end - start))
            size += int(room[end - start - 1])
            if size >= CHUNK_BYTES or end < len(lengths):
                yield drawn()
                held, size = [], 0
            start = end
    if held:
        yield drawn()


def heavy_prefixes(rows: DataFrame, groups: int) -> np.ndarray:
    """Hashes of prefixes that may hold more than a ``HEAVY``-th of a group, up to ``DEPTH`` - 1 words long, sorted.

    With a limit of the share s of all suffixes, a chunk reports what has s / 2 of its own. What no chunk reports adds up to
    less than s / 2, so a prefix above s is reported with s / 2 or more; at most 2 / s prefixes of a length are.
    """
    share = 1 / (groups * HEAVY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in chunks(batches):
            total = int(own.counts.sum())
            hashes, found = own.hashes(DEPTH - 1), [(0, total)]
            for depth in range(1, DEPTH):
                first, counts = own.prefixes(depth)
                often = counts >= max(1, total * share / 2)
                found += zip(hashes[depth - 1][first[often]].view(np.int64).tolist(), counts[often].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["prefix", "n"])

    seen = cut(rows.mapInArrow(run, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")))
    total = seen.filter("prefix = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    found = seen.filter((F.col("prefix") != 0) & (F.col("n") >= total * share / 2)).select("prefix")
    return np.sort(np.array([r.prefix for r in found.collect()], np.int64).view(np.uint64))  # 6 x HEAVY x groups at most, eight bytes each


def blocks(rows: DataFrame, groups: int, heavy: np.ndarray) -> DataFrame:
    """Packed suffixes, one row for each chunk and group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in chunks(batches):
            if not own.rows():
                continue
            hashes = own.hashes(DEPTH)
            route = hashes[0].copy()
            extend = np.ones(len(route), bool)
            for depth in range(1, DEPTH):
                extend &= in_sorted(hashes[depth - 1], heavy) & (own.codes[depth] > 0)
                route[extend] = hashes[depth][extend]
            group = (route % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group.astype(np.uint16) if groups <= 1 << 16 else group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order])) + 1
            packed = [pack(own, part) for part in np.split(order, edges)]
            yield pa.RecordBatch.from_arrays([
                pa.array(group[order][np.concatenate([[0], edges])]), pa.array([own.langs] * len(packed), pa.list_(pa.string())), pa.array(packed, pa.binary())],
                names=["grp", "langs", "packed"])

    return rows.mapInArrow(run, BLOCKS)


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes that hold them all."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def pack(own: Suffixes, part: np.ndarray) -> bytes:
    """Some suffixes in one string of bytes: sizes, languages, codes, counts, and the words that occur in them."""
    codes = np.concatenate([c[part] for c in own.codes])
    seen = np.zeros(len(own.words) + 1, bool)
    seen[codes] = True
    seen[0] = False
    used = np.flatnonzero(seen)
    local = np.zeros(len(seen), np.uint32)
    local[used] = np.arange(1, len(used) + 1)
    words = own.words.take(pa.array(used - 1))
    columns = [narrow(own.lang[part]), narrow(local[codes]), narrow(own.counts[part]), narrow(pc.binary_length(words).to_numpy())]
    head = np.array([x for c in columns for x in (len(c), c.itemsize)], np.int64)
    return b"".join([head.tobytes(), *(c.tobytes() for c in columns), letters_of(words)])


def letters_of(words: pa.Array) -> bytes:
    """All words one after the other."""
    if not len(words):
        return b""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    return words.buffers()[2][int(ends[0]):int(ends[-1])].to_pybytes()


def opened(packed: bytes) -> list[np.ndarray]:
    """Languages, codes, counts, lengths of words, and their letters."""
    head, at, out = np.frombuffer(packed, np.int64, 8), 64, []
    for length, width in head.reshape(4, 2).tolist():
        out.append(np.frombuffer(packed, f"u{width}", length, at))
        at += length * width
    return [*out, np.frombuffer(packed, np.uint8, offset=at)]


def unpacked(table: pa.Table) -> Suffixes:
    """The suffixes of all blocks of a group, on one list of words, merged."""
    langs: dict[str, int] = {}
    parts = [opened(x) for x in table.column("packed").to_pylist()]
    lengths, letters = np.concatenate([p[3].astype(np.int64) for p in parts]), np.ascontiguousarray(np.concatenate([p[4] for p in parts]))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    index = np.concatenate([[0], words.indices.to_numpy().astype(np.int32) + 1]).astype(np.int32)
    lang, codes, at = [], [], 0
    for names, (own_lang, own_codes, _, own_lengths, _) in zip(table.column("langs").to_pylist(), parts):
        lang.append(np.array([langs.setdefault(x, len(langs)) for x in names], np.int32)[own_lang])
        codes.append(index[np.where(own_codes > 0, own_codes.astype(np.int64) + at, 0)].reshape(DEPTH, -1))
        at += len(own_lengths)
    counts = np.concatenate([p[2].astype(np.int64) for p in parts])
    return Suffixes(list(langs), words.dictionary.cast(pa.binary()), np.concatenate(lang), list(np.concatenate(codes, axis=1)), counts).merged()


def nodes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, a): every phrase of up to ``DEPTH`` words with its count, those of ``least`` and more, and all words' total as size 0."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(8, -(-2 * size // GROUP_BYTES))
    heavy = heavy_prefixes(rows, groups)

    def build(table: pa.Table) -> pa.Table:
        tree = unpacked(table)
        out = {"lang": [], "phrase": [], "size": [], "a": []}
        hashes = tree.hashes(DEPTH - 1)
        names = pa.array(tree.langs, pa.string())
        shared = np.ones(tree.rows(), bool)  # nodes above the prefix that was routed; other groups hold more of them
        for depth in range(1, DEPTH + 1):
            first, counts = tree.prefixes(depth)
            if depth < DEPTH:
                shared = shared & in_sorted(hashes[depth - 1], heavy)
                chosen = (counts >= least) | shared[first]
            else:
                chosen = counts >= least
            first, counts = first[chosen], counts[chosen]
            words = [tree.words.take(pa.array(c[first] - 1)) for c in tree.codes[:depth]]
            out["lang"].append(names.take(pa.array(tree.lang[first])))
            out["phrase"].append(pc.binary_join_element_wise(*words, b" ").cast(pa.string()))
            out["size"].append(pa.array(np.full(len(first), depth, np.int32)))
            out["a"].append(pa.array(counts.astype(np.int64)))
        total = np.bincount(tree.lang, tree.counts, len(tree.langs)).astype(np.int64)
        out["lang"].append(names)
        out["phrase"].append(pa.array([""] * len(names), pa.string()))
        out["size"].append(pa.array([0] * len(names), pa.int32()))
        out["a"].append(pa.array(total))
        return pa.table({k: pa.chunked_array(v) for k, v in out.items()})

    dealt = blocks(rows, groups, heavy).repartition(groups, "grp")  # as many tasks as groups, so none grows with the input
    parts = dealt.groupBy("grp").applyInArrow(build, "lang string, phrase string, size int, a long")
    return parts.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).filter((F.col("a") >= least) | (F.col("size") == 0))


def exact(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def candidates(found: DataFrame, covered: tuple[int, int] = COVERED) -> DataFrame:
    """Phrases of two and more words that no longer phrase covers."""
    several = found.filter("size >= 2").withColumn("words", F.split("phrase", " "))
    parts = F.expr("array_distinct(flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), s -> array_join(slice(words, s, n), ' ')))))")
    inner = several.filter("size >= 3").select("lang", "a", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    share, whole = covered
    kept = several.join(inner, ["lang", "phrase"], "left")
    return kept.filter(F.col("longer").isNull() | (exact(F.col("longer")) * whole < exact(F.col("a")) * share)).drop("longer")


def scored(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Each phrase with its lowest-scoring cut: (lang, phrase, a, l, r, score)."""
    cuts = kept.select("lang", "phrase", "size", "words", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"), F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest"))
    counts = found.filter(F.col("size").between(1, DEPTH - 1)).select("lang", F.col("phrase").alias("part"), "a")
    both = lookup_join(cuts, counts.select("lang", F.col("part").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    both = lookup_join(both, counts.select("lang", F.col("part").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    return both.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "w.l", "w.r", "w.score")


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, ranked; parts of a language are ranked first, so no task sees a whole one."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.drop("rank", "_salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language."""
    found = keep(nodes(docs, least))
    ranked = best(scored(found, candidates(found)), top)
    totals = found.filter("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
