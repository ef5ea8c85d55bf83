"""Licence scans by MinHash bands over overlapping windows.

Words are runs of letters, digits and underscores, lower-cased; shingles are five
words. A template of n words is looked for in windows of twice its class's size,
one class size apart (classes are powers of two from eight words), so any place
where it could stand lies whole in a window. Template and window are compared by
MinHash bands: from the smallest template of a class, the containment asked for
and the window's size follows the least similarity that counts, and from that the
number of bands that makes the chance of a miss at most ``MISS``. Every window and
template that agree in a band are then verified by the exact share of the
template's shingles in the window.

A band can only agree if its smallest hash belongs to a shared shingle, so windows
without any shingle of any template are passed over before hashing; this loses
nothing. The templates' shingles go to every task, and their number is checked.

Null texts are empty. Texts and templates of fewer than five words hold nothing to
compare and give no row. Repeated rows are reported once per id and text, null ids
are kept, other columns left out; empty tables give an empty result.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import texts

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-4
ROWS = 1  # hashes in a band; more would ask for more than the small share a short notice has of its window
SMALLEST_CLASS = 8
MOST_SHINGLES = 1 << 20  # of all templates, in every task
WORD = re.compile(r"\w+")
KNOWN_WORDS = 1 << 18
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
WINDOWS = "doc_id long, tag long, size int, start int, shingles array<long>, bands array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * ODD[4]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Shingle hashes of texts; remembers words' hashes up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if len(words) < SHINGLE:
            return np.empty(0, np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        hashes = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w.encode())) for w in words), np.uint64, len(words))
        last = len(hashes) - SHINGLE + 1
        total = np.zeros(last, np.uint64)
        for k in range(SHINGLE):
            total += mixed(hashes[k:k + last] * ODD[k])
        return mixed(total)


def class_of(words: int) -> int:
    return max(SMALLEST_CLASS, 1 << (words - 1).bit_length())


def bands_for(size: int, smallest: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands that a template of ``smallest`` shingles needs in a window of ``2 * size`` words."""
    shared = math.ceil(contained * smallest)
    window = 2 * size - SHINGLE + 1
    similarity = shared / (smallest + window - shared)
    return math.ceil(math.log(miss) / math.log(1 - similarity ** ROWS))


def signature(shingles: np.ndarray, bands: int) -> np.ndarray:
    """The smallest hash of each band, with the band's number mixed in."""
    seeds = mixed(np.arange(1, bands + 1, dtype=np.uint64) * ODD[1])
    return mixed(mixed(shingles[None, :] ^ seeds[:, None]).min(axis=1) + seeds)


def template_rows(templates: list[tuple[int, str, str]]) -> list[tuple[int, str, int, list[int]]]:
    """(id, licence, class size, shingle hashes) of each template that has shingles."""
    own = Shingler()
    found = []
    for key, licence, text in templates:
        shingles = np.unique(own.shingles(text))
        if len(shingles):
            found.append((key, licence, class_of(len(WORD.findall(text.lower()))), shingles))
    if sum(len(s) for *_, s in found) > MOST_SHINGLES:
        raise ValueError("more templates than a task should hold; scan with parts of them")
    return found


def windows(docs: DataFrame, classes: dict[int, int], wanted: np.ndarray) -> DataFrame:
    """Windows that hold a wanted shingle, with their shingles and band keys. ``classes``: size to bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler()
        for batch in batches:
            rows = []
            for key, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")):
                shingles = own.shingles(text.as_py())
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, shingles), len(wanted) - 1)] == shingles)
                for size, bands in classes.items() if len(at) else ():
                    places = np.unique(np.concatenate([at // size, at // size - 1]))
                    for start in (places[places >= 0] * size).tolist():
                        held = np.unique(shingles[start:start + 2 * size - SHINGLE + 1])
                        rows.append((key, tag, size, start, held.view(np.int64), signature(held, bands).view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["doc_id", "tag", "size", "start", "shingles", "bands"])

    return texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(run, WINDOWS)


def scan(docs: DataFrame, templates: list[tuple[int, str, str]], contained: float = CONTAINED) -> DataFrame:
    """(doc_id, tag, template_id, license, n_shared, n_shingles, first_word): every document and template where a window
    holds the template, with the largest share of any window and the first such window's first word."""
    spark, rows = docs.sparkSession, template_rows(templates)
    if not rows:
        return spark.createDataFrame([], "doc_id long, tag long, template_id long, license string, n_shared int, n_shingles int, first_word int")
    classes = {size: bands_for(size, min(len(s) for _, _, c, s in rows if c == size), contained) for size in sorted({r[2] for r in rows})}
    wanted = np.unique(np.concatenate([r[3] for r in rows]))
    held = spark.createDataFrame(
        [(key, licence, size, s.view(np.int64).tolist(), signature(s, classes[size]).view(np.int64).tolist()) for key, licence, size, s in rows],
        "template_id long, license string, size int, wanted array<long>, keys array<long>")
    own = windows(docs, classes, wanted)
    met = own.withColumn("band", F.explode("bands")).drop("bands").join(
        F.broadcast(held.withColumn("band", F.explode("keys")).drop("keys")), ["size", "band"])  # bounded by MOST_SHINGLES
    checked = met.select(
        "doc_id", "tag", "template_id", "license", F.col("start").alias("first_word"), F.size("wanted").alias("n_shingles"),
        F.size(F.array_intersect("wanted", "shingles")).alias("n_shared")).filter(F.col("n_shared") >= contained * F.col("n_shingles"))
    return checked.groupBy("doc_id", "tag", "template_id", "license", "n_shingles").agg(
        F.max("n_shared").alias("n_shared"), F.min("first_word").alias("first_word"))
