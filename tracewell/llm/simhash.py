"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, and two texts are linked when at most four differ.
Cut into three segments, one segment then differs by at most one bit. Every
segment is therefore indexed once per position with that bit left out: two
segments that differ nowhere, or only there, have a variant in common. Equal
variants are brought together, the full fingerprints compared, and the links
joined to components.

Texts with equal fingerprints are one entry from the start, so a group of
copies costs one row per task. Fingerprints that share a variant are compared in
one streaming pass over sorted rows; of a run only a spanning forest is
emitted, never all pairs, and long runs are first dealt by equal fifths of the
fingerprint, which any two linked ones must share.

Null texts are empty. Texts without words have fingerprint zero. A null id
counts as no id: such rows get a component but never name one, unless all ids
in it are null. Repeated rows are one entry and all appear in the result. An
empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tracewell.llm.common import components, texts, with_columns
from tracewell.storage import keep

BITS = 64
LINK_BITS = 4
SEED = 42
SHINGLE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # offset and width: four bits over three segments leave one with at most one
SHORT_RUN = 16
LONG_RUN = 2048
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the shingle hashes, as an unsigned number."""
    words = text.encode().translate(LOWER).split()  # bytes.split parts at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    last = len(words) - shingle + 1
    counts = np.zeros(BITS, np.int64)
    starts, ends = starts[:last].tolist(), ends[shingle - 1:].tolist()
    for at in range(0, last, 1 << 16):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def compute(batch: pa.RecordBatch) -> list:
        found = [fingerprint_of(t, shingle) for t in batch.column("text").to_pylist()]
        return [np.array(found, np.uint64).view(np.int64)]

    return with_columns(texts(docs), [StructField("fp", LongType())], compute).select("doc_id", "fp")


def variants(fps: np.ndarray) -> np.ndarray:
    """Keys of all one-wildcard segment variants, a row per fingerprint and a column per left-out bit."""
    found = []
    for offset, width in SEGMENTS:
        segment = (fps >> np.uint64(offset)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            low = segment & np.uint64((1 << bit) - 1)
            high = (segment >> np.uint64(bit + 1)) << np.uint64(bit)
            found.append(np.uint64((offset + bit) << 22) | high | low)
    return np.stack(found, axis=1)


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is linked among distinct fingerprints of one run."""
    if len(fps) > LONG_RUN:
        edges = []
        for offset, width in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)):
            part = (fps >> np.uint64(offset)) & np.uint64((1 << width) - 1)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for run in np.split(fps[order], cuts):
                if len(run) > 1:
                    edges += grown(run)
        return edges
    return grown(fps)


def grown(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    edges, left = [], fps
    while len(left) > 1:
        root, left, waiting = left[0], left[1:], [left[0]]
        while waiting and len(left):
            near = np.bitwise_count(left ^ waiting.pop()) <= LINK_BITS
            if near.any():
                found, left = left[near], left[~near]
                waiting.extend(found)
                edges.append((found, np.full(len(found), root)))
    return edges


def run_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys; keys are sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    for lag in range(1, min(SHORT_RUN, sizes.max(initial=0))):
        at = np.flatnonzero((keys[lag:] == keys[:-lag]) & (np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= LINK_BITS))
        left.append(fps[at + lag])
        right.append(fps[at])
    for start, size in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        for found, root in forest(np.unique(fps[start:start + size])):
            left.append(found)
            right.append(root)
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): linked fingerprints, enough of them to connect every component."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at:at + 4096]
                keys = variants(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.uint64), np.empty(0, np.uint64)

        def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy().view(np.uint64)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last run may go on
            if whole:
                yield found(*map(np.ascontiguousarray, run_links(keys[:whole], fps[:whole])))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield found(*map(np.ascontiguousarray, run_links(keys, fps)))

    rows = distinct.select("fp").mapInArrow(spread, "key long, fp long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_fingerprint): a row per input row, with its fingerprint in hex,
    the smallest id it is connected to and one fingerprint that names its component."""
    prints = keep(fingerprints(docs, shingle))
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = keep(placed.join(lowest, "root").select("fp", "component_id", "root"))
    return prints.join(named, "fp").select("doc_id", hexed("fp").alias("fingerprint"), "component_id", hexed("root").alias("component_fingerprint"))


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, one row per id; all columns stay.

    Rows without an id stay only where their component has no id at all, one of each.
    """
    near = near_duplicates(docs, shingle)
    kept = near.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_llm_id")).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long") == kept["_llm_id"], "left_semi").dropDuplicates(["doc_id"])
    nameless = near.filter("component_id IS NULL AND fingerprint = component_fingerprint").select(F.col("fingerprint").alias("_llm_fp")).distinct()
    bare = docs.filter("doc_id IS NULL").withColumn("_llm_text", F.coalesce("text", F.lit("")))
    bare = with_columns(bare, [StructField("_llm_print", LongType())], lambda batch: [
        np.array([fingerprint_of(t, shingle) for t in batch.column("_llm_text").to_pylist()], np.uint64).view(np.int64)])
    bare = bare.join(nameless, hexed("_llm_print") == nameless["_llm_fp"], "left_semi").dropDuplicates(["_llm_print"])
    return rows.unionByName(bare.select(*docs.columns))
