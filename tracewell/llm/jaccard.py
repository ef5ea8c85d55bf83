"""Near-duplicates by exact Jaccard similarity of word shingles.

Two texts are linked when their sets of five-word shingles have a Jaccard
similarity of 0.8 or more; a text with fewer words is one shingle. Candidates come
from SimHash fingerprints of the same shingles by the deletion variants of
``simhash``, which bring together what differs in four bits or fewer. That is about
0.95 and more; the others meet in MinHash bands: 24 bands of five minima, so a pair at exactly 0.8 shares no band
with a probability of (1 - 0.8^5)^24 = 7e-5, one at 0.85 with 8e-7. Every candidate
is checked on the whole sets, and links are joined to components.

Texts with equal sets are one entry from the start. In a band of few members all
are compared. In a crowded one every member is compared with nine hubs only, which
settles groups that link. A crowd takes its centre from the earliest crowd that any of its
members is in, so crowds of one group share centre and hubs, and a member has few centres however many bands it is in.
Where a crowd stays open, most of what its members share is
one common text, so that part is taken away: what is left of a member is its symmetric
difference D with the centre, the shingles that most of nine of them have. Two members
link just when |Dx| + |Dy| - 2 |Dx & Dy| <= (|x| + |y|) / 9, whatever the centre. Members that
changed different places thus link by their slack |x| - 9 |D| alone, if the sum of both is
not negative, and then both link to the member with the most slack: all are compared with that one. Others must have
the more in common in their differences the further they are from the centre, while those of
texts that were changed here and there have next to nothing. The members therefore
meet again in MinHash bands of their differences. Up to ``WIDE`` members of such a band are all paired, and of these pairs those
go that differ too much by the bits that their differences leave in ``marks``: a bound that no linked pair fails. In a more crowded
band every member stays, under the centre of that very crowd, and so on until no crowd is open, at most ``LEVELS`` times;
the rest is paired whole. A pair is compared once.

Pairs of a crowd that reach the threshold by what they changed alike are found with a
probability of 0.94 where that is a third of their differences, of 0.99 from 0.45 on, if their band has no crowd again; those that
reach it by their slack are found for certain under a common centre. All this is no matter outside of crowds.

Words are parted at ASCII white space, ASCII letters are lowered. Null texts are
empty; texts without words are one entry. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from tracewell.llm import simhash
from tracewell.llm.common import components, with_columns
from tracewell.llm.lines import keyed
from tracewell.storage import keep

SHINGLE = 5
SHARED, WHOLE = 4, 5  # linked from a similarity of SHARED / WHOLE
FAR = (WHOLE + SHARED) // (WHOLE - SHARED)  # linked where the sets differ in at most a FAR-th of their sizes together
BANDS, MINIMA = 24, 5
CROWD = 8  # members of a band beyond which they are compared with hubs
JURY, SALTS = 9, 64  # a jury's members are hubs that are compared with, their majority is the centre
INNER_BANDS, INNER_MINIMA = 24, 2  # of differences
WIDE = 256  # members of a band of differences beyond which they get a centre of their own
MARKS = 8  # words of 64 bits for what is in a difference
LEVELS = 5
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(SEED)
HASHES = 180  # at least as many as any bands have minima
TURNS = _rng.integers(0, (1 << 64) - 1, HASHES, np.uint64)
FACTORS = _rng.integers(0, (1 << 64) - 1, HASHES, np.uint64) | np.uint64(1)


def shingles_of(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    words = text.encode().translate(LOWER).split()  # bytes.split parts at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - shingle + 1
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[shingle - 1:].tolist())), np.uint64, last))


def print_of(hashes: np.ndarray) -> int:
    """Names a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def bands_of(hashes: np.ndarray, bands: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """A key per band; none for the empty set."""
    if not len(hashes):
        return hashes
    n = bands * minima
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[at:at + 4096, None] ^ TURNS[:n]) * FACTORS[:n]).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(bands, minima))], np.uint64)


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, tag, fp, bands, sim) of each row; id and tag as of ``lines.keyed``, sim the SimHash fingerprint."""

    def compute(batch: pa.RecordBatch) -> list:
        texts = batch.column("text").to_pylist()
        sets = [shingles_of(t, shingle) for t in texts]
        sims = np.array([simhash.fingerprint_of(t, shingle) for t in texts], np.uint64)
        return [np.array([print_of(s) for s in sets], np.uint64).view(np.int64), [bands_of(s).view(np.int64) for s in sets], sims.view(np.int64)]

    rows = keyed(docs).select(F.col("_llm_id").alias("id"), F.col("_llm_tag").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    return with_columns(rows, [StructField("fp", LongType()), StructField("bands", ArrayType(LongType())), StructField("sim", LongType())], compute).drop("text")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, hashes) of the texts with the tags that ``wanted`` (fp, tag) names."""
    texts = docs.select(F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(wanted, "tag").dropDuplicates(["tag"])
    return with_columns(rows, [StructField("hashes", ArrayType(LongType()))], lambda batch: [
        [shingles_of(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]]).select("fp", "hashes")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are linked: exact, on the whole sets, a pair at a time in memory."""
    own = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("a_set")), "a")
    both = own.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("b_set")), "b")
    one, other = F.size("a_set"), F.size("b_set")
    near = both.filter(F.least(one, other) * WHOLE >= F.greatest(one, other) * SHARED)  # first, as it needs no look at the sets
    return near.filter(F.size(F.array_intersect("a_set", "b_set")) * (WHOLE + SHARED) >= (one + other) * SHARED).select("a", "b")


def centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(centre, shared): the shingles that most of each jury have."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("own"):
                values, votes = np.unique(own.values.flatten().to_numpy(), return_counts=True)
                out.append(values[2 * votes > len(own)])
            yield pa.RecordBatch.from_arrays([batch.column("centre"), pa.array(out, pa.list_(pa.int64()))], names=["centre", "shared"])

    seats = members.dropDuplicates(["centre"]).select("centre", F.explode("jury").alias("fp"))
    return seats.join(sets, "fp").groupBy("centre").agg(F.collect_list("hashes").alias("own")).mapInArrow(vote, "centre long, shared array<long>")  # JURY sets each


def marks_of(left: np.ndarray) -> np.ndarray:
    """A bit for each place that an element of a difference falls on."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[left % np.uint64(64 * MARKS)] = 1
    return np.packbits(bits).view(np.int64)


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, centre, slack, far, marks, keys): slack, size, marks and bands of the difference of each (fp, centre) of ``members``; members with one centre meet."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [left.values.to_numpy().view(np.uint64) for left in batch.column("apart")]
            found = [np.unique(bands_of(left, INNER_BANDS, INNER_MINIMA) ^ np.uint64(centre & (1 << 64) - 1)).view(np.int64) for centre, left in zip(batch.column("centre").to_pylist(), apart)]
            arrays = [pa.array(a, pa.list_(pa.int64())) for a in ([marks_of(left) for left in apart], found)]
            yield pa.RecordBatch.from_arrays([*batch.select(["fp", "centre", "slack", "far"]).columns, *arrays], names=["fp", "centre", "slack", "far", "marks", "keys"])

    own = members.select("fp", "centre").distinct().join(sets, "fp").join(keep(centres(members, sets)), "centre")
    apart = own.select("fp", "centre", F.size("hashes").alias("n"), F.concat(F.array_except("hashes", "shared"), F.array_except("shared", "hashes")).alias("apart"))
    return apart.select("fp", "centre", (F.col("n") - FAR * F.size("apart")).cast("long").alias("slack"), F.size("apart").alias("far"), "apart").mapInArrow(
        keys, "fp long, centre long, slack long, far int, marks array<long>, keys array<long>")


def possible() -> Column:
    """Whether members a and b of a band of differences can be linked: what only one of them has marks for, they do not share."""
    shared = []
    for one, other in ("ab", "ba"):
        alone = sum((F.bit_count(F.get(f"{one}_marks", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"{other}_marks", F.lit(i))))) for i in range(MARKS)), F.lit(0))
        shared.append(F.col(f"{one}_far") - alone)
    return F.least(*shared) * (2 * FAR) + F.col("a_slack") + F.col("b_slack") >= 0


def paired(few: DataFrame) -> DataFrame:
    """(a, b): members of one key that are not known to be connected; of bands of differences only those that can be linked."""
    inner = "marks" in few.columns
    carried = ["fp", "root", *(["slack", "far", "marks"] if inner else [])]
    ends = [few.select("key", *(F.col(c).alias(end if c == "fp" else f"{end}_{c}") for c in carried)) for end in "ab"]
    met = F.expr("a > b AND a_root <> b_root")
    return ends[0].join(ends[1], "key").filter(met & possible() if inner else met).select("a", "b")


def closest(parted: DataFrame) -> DataFrame:
    """(a, b): each member of ``parted`` with the one that has the most slack of their centre, if the two are not known to be connected."""
    best = parted.groupBy("centre").agg(F.max(F.struct("slack", "fp", "root")).alias("best")).select("centre", F.col("best.fp").alias("hub"), F.col("best.root").alias("hub_root"))
    return ordered(parted.join(best, "centre").filter("root <> hub_root"), "fp", "hub")


def ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """(a, b): pairs of different entries, the greater first."""
    return pairs.filter(F.col(one) != F.col(other)).select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b"))


def counted(keys: DataFrame) -> DataFrame:
    """Adds n, the number of members, and first, the first of them in the order of a hash, to the rows (key, fp, ..) of keys that can connect
    something: of more than one member, and with ``root`` of more than one component. What a key has is summed up, and only these are carried on."""
    order = F.struct(F.xxhash64("fp").alias("at"), "fp")
    root = "root" if "root" in keys.columns else "fp"
    open_keys = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order)["fp"].alias("first"), F.min(root).alias("r"), F.max(root).alias("s"))
    return keys.join(open_keys.filter("r <> s").drop("r", "s"), "key")


def juries(crowded: DataFrame) -> DataFrame:
    """(key, centre, jury): crowds that have the same first member, in the order of a hash, share a centre and a jury.

    The first member is itself in each of these crowds, so there are no more of them than a text has keys.
    """
    order = F.struct(F.xxhash64("fp").alias("at"), "fp")
    parts = crowded.groupBy("key", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt")).agg(F.min(order).alias("first"))
    seats = parts.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("first")), 1, JURY).alias("seats"))  # of SALTS
    named = keep(seats.select("key", F.col("seats")[0]["fp"].alias("centre"), "seats"))
    shared = named.groupBy("centre").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seats")))), 1, JURY).alias("jury"))
    return named.select("key", "centre").join(shared.select("centre", F.col("jury.fp").alias("jury")), "centre")


def with_centres(crowded: DataFrame) -> DataFrame:
    """The rows (key, fp, centre, ..) of crowds with the centre of the earliest crowd that a member of the key's is in.

    Members of one key thus always share a centre, and a group whose bands overlap has few of them.
    """
    order = F.struct(F.xxhash64("centre").alias("at"), "centre")
    first = crowded.groupBy("fp").agg(F.min(order).alias("first"))
    chosen = crowded.select("key", "fp").join(first, "fp").groupBy("key").agg(F.min("first")["centre"].alias("centre"))
    return crowded.drop("centre").join(chosen, "key")


def alike(distinct: DataFrame) -> DataFrame:
    """(a, b): entries (fp, sim, ..) that SimHash's deletion variants bring together, a star for equal fingerprints and a forest for near ones."""
    stars = keep(distinct.filter(F.size("bands") > 0).groupBy("sim").agg(F.min("fp").alias("star")))
    near = simhash.links(stars.select(F.col("sim").alias("fp")))
    ends = [stars.select(F.col("sim").alias(end), F.col("star").alias(f"{end}_star")) for end in "ab"]
    forest = near.distinct().join(ends[0], "a").join(ends[1], "b")
    equal = distinct.filter(F.size("bands") > 0).select("fp", "sim").join(stars, "sim")
    return ordered(forest, "a_star", "b_star").unionAll(ordered(equal, "fp", "star"))


def connected(members: DataFrame, sets: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(node, root): components of the linked entries; ``members`` (key, fp, n, first) are the bands with more than one member,
    ``first`` (a, b) pairs that are compared besides."""
    done = members.sparkSession.createDataFrame([], "a long, b long")
    more = done if first is None else first
    roots = members.sparkSession.createDataFrame([], "node long, root long")
    members = members.withColumn("root", F.col("fp"))
    for level in range(LEVELS + 1):
        most = CROWD if level == 0 else WIDE
        both = paired(members.filter(F.lit(True) if level == LEVELS else F.col("n") <= most)).unionAll(more)
        crowded = members.filter(F.col("n") > most).withColumnRenamed("first", "centre").drop("slack", "far", "marks")
        last = level == LEVELS or crowded.isEmpty()
        if not last:
            named = keep(juries(crowded).select("centre", "jury").dropDuplicates(["centre"]))
            crowded = keep(with_centres(crowded)) if level == 0 else crowded
            seats = with_roots(named.select("centre", F.explode("jury").alias("fp")), roots).select("centre", F.col("fp").alias("hub"), F.col("root").alias("hub_root"))
            seen = crowded.select("fp", "root", "centre").distinct().join(seats, "centre").filter("root <> hub_root")
            both = both.unionAll(ordered(seen, "fp", "hub"))
        pairs = keep(both.distinct().join(done, ["a", "b"], "left_anti"))
        done = done.unionAll(pairs)
        found = keep(verified(pairs, sets))
        roots = components(found) if level == 0 else merged(roots, found)
        if last:
            return roots
        roots = keep(roots)
        crowded = with_roots(crowded.drop("root"), roots)
        open_keys = crowded.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
        still = crowded.join(open_keys, "key", "left_semi").select("fp", "centre").distinct()
        parted = keep(with_roots(differences(keep(still.join(named, "centre")), sets), roots))
        more = closest(parted)
        members = keep(counted(keep(parted.select(F.explode("keys").alias("key"), "fp", "root", "slack", "far", "marks"))))
    return roots


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) with the links ``found`` (a, b) added: only the components that these connect are walked again."""
    ends = found
    for end in "ab":
        known = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        ends = ends.join(known, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    met = components(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    moved = roots.join(met.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
    return moved.select("node", F.coalesce("new", "root").alias("root")).unionAll(met)  # a root is no node of its own


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the component that each is known to be in."""
    return members.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def placed_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, tag, fp, root): each row with its entry and the entry that names its component."""
    found = keep(prints(docs, shingle))
    distinct = keep(found.groupBy("fp").agg(F.min("tag").alias("tag"), F.first("bands").alias("bands"), F.min("sim").alias("sim")))
    members = keep(counted(distinct.select(F.explode("bands").alias("key"), "fp")))
    first = keep(alike(distinct))
    met = members.select("fp").unionAll(first.select("a")).unionAll(first.select("b")).distinct()
    wanted = distinct.select("fp", "tag").join(met, "fp", "left_semi")
    roots = connected(members, keep(sets_of(docs, wanted, shingle)), first)
    rows = found.select("id", "tag", "fp")
    return rows.join(roots, rows["fp"] == roots["node"], "left").select("id", "tag", "fp", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest id and then the smallest text hash; all columns stay.

    A row without an id stays only where its component has no id at all.
    """
    near = placed_rows(docs, shingle)
    kept = near.groupBy("root").agg(F.min(F.struct("id", "tag")).alias("f")).select(F.col("f.id").alias("_llm_id"), F.col("f.tag").alias("_llm_tag"))
    rows = keyed(docs).join(kept, ["_llm_id", "_llm_tag"], "left_semi").dropDuplicates(["_llm_id", "_llm_tag"])
    return rows.select(*docs.columns)
